"""Fixed values.

Word lists, lookup tables, constants and patterns whose content decides the result, so they have
to be exactly these.  Patterns are written for Java; :func:`guidemill.functions.matching.rx` adds
the flags (Unicode classes, case handling, only a newline ends a line).
"""

# --- fixed values: section ids of the technical manuals, in the order they are tried -------------
MANUAL_ID_PATTERNS = {
    "vat_manual": r"\b(VAT(?:REG|SC|TOS|INF|IT|NOT|POSS|FRS|REC|AOS|GEN|ADJ|PE|RA|SG|AM|DT|LAND|FIN|FS)[0-9]{5})\b",
    "ct_manual": r"\b(CTM[0-9]{5})\b",
    "cg_manual": r"\b(CG[0-9]{5})\b",
    "bim_manual": r"\b(BIM[0-9]{5})\b",
    "eim_manual": r"\b(EIM[0-9]{5})\b",
    "trusts_manual": r"\b(TSEM[0-9]{5})\b",
    "savings_manual": r"\b(SAIM[0-9]{5})\b",
    "property_manual": r"\b(PIM[0-9]{5})\b",
    "ni_manual": r"\b(NIM[0-9]{5})\b",
    "paye_manual": r"\b(PAYE[0-9]{5})\b",
    "compliance_handbook": r"\b(CH[0-9]{5})\b",
}

# --- fixed values: manual name by id prefix, first prefix that fits -------------------------------
MANUAL_NAMES = {
    "VAT": "VAT Manual",
    "CTM": "Corporation Tax Manual",
    "CG": "Capital Gains Manual",
    "BIM": "Business Income Manual",
    "EIM": "Employment Income Manual",
    "TSEM": "Trusts Manual",
    "SAIM": "Savings Manual",
    "PIM": "Property Income Manual",
    "NIM": "National Insurance Manual",
    "PAYE": "PAYE Manual",
    "CH": "Compliance Handbook",
}

# --- fixed values: manual families that have a web address ---------------------------------------
MANUALS_WITH_ADDRESS = ["vat_manual", "ct_manual", "cg_manual", "bim_manual", "eim_manual", "ni_manual", "paye_manual"]
MANUAL_ADDRESS = "https://www.gov.uk/hmrc-internal-manuals/"
SITE_ADDRESS = "https://www.gov.uk"

# --- fixed values: html elements ------------------------------------------------------------------
NOISE_ELEMENTS = ["script", "style", "nav", "header", "footer", "aside", "noscript", "iframe", "svg",
                  "form", "button", "input", "select", "textarea"]
BLOCK_ELEMENTS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "hr", "blockquote",
                  "pre", "article", "section", "main"]
HEADING_ELEMENTS = ["h1", "h2", "h3", "h4", "h5", "h6"]

# --- fixed values: break patterns of the splitter ------------------------------------------------
PARAGRAPH_BREAK = r"\n\n+"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"

# --- fixed values: wording that marks legal content ----------------------------------------------
# (flags, pattern, words of which every match holds one)
CONDITION_LEAD_IN = (
    r"(?:you\s+(?:must|should|can(?:not)?|need\s+to|will\s+need\s+to)"
    r"|(?:a\s+)?(?:person|business|company|trader)\s+(?:must|should|can)"
    r"|(?:this|the\s+following)\s+(?:applies?|conditions?)\s+(?:if|when|where)"
    r"|if\s+(?:any|all)\s+of\s+the\s+following"
    r"|you'?re?\s+(?:required|obliged)\s+to)[^.]*:"
)
CONDITION_ITEM = r"^\s*\(([a-z])\)\s*"
DEFINITION_WORDING = [
    ("i", r"['\"]([^'\"]+)['\"]\s+(?:means|has\s+the\s+meaning|is\s+defined\s+as|refers?\s+to)", ("means", "meaning", "defined", "refer")),
    ("i", r"\b(?:the\s+term\s+)?['\"]([^'\"]+)['\"]\s+(?:means|is|includes)", ("'", '"')),
    ("m", r"^([A-Z][a-z]+(?:\s+[a-z]+)*)\s*[-–]\s*(?:means|is|the)", ("-", "–")),
]
EXAMPLE_WORDING = [
    ("i", r"\b(?:example|for\s+example|e\.g\.)\s*[:\-]", ("example", "e.g.")),
    ("i", r"\b(?:suppose|consider|imagine|let's\s+say)\b", ("suppose", "consider", "imagine", "say")),
    ("", r"\b(?:Sarah|John|Mary|James|Company\s+[A-Z]|ABC\s+Ltd)\b", ("sarah", "john", "mary", "james", "company", "abc")),
    ("i", r"(?:earns?|has\s+(?:income|turnover|profit)\s+of)\s+£[0-9,]+", ("£",)),
]
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September",
          "October", "November", "December"]
MONTH_WORDS = "(?:" + "|".join(MONTHS) + ")"
DEADLINE_WORDING = [
    ("i", r"\b([0-9]{1,2}\s+" + MONTH_WORDS + r")\b", tuple(m.lower() for m in MONTHS)),
    ("i", r"\b(?:deadline|due\s+(?:date|by)|must\s+be\s+(?:filed|submitted|paid)\s+by)\b", ("deadline", "due", "must")),
    ("i", r"\b(?:within\s+[0-9]+\s+(?:days?|months?|weeks?))\b", ("within",)),
]
PENALTY_WORDING = [
    ("i", r"\b(?:penalty|penalties|fine|fines|surcharge|interest)\b", ("penalt", "fine", "surcharge", "interest")),
    ("i", r"\b(?:late\s+(?:filing|payment|submission))\b", ("late",)),
    ("i", r"(?:£[0-9]+(?:,[0-9]+)*)\s*(?:penalty|fine)", ("£",)),
]
CONTACT_WORDING = [
    ("i", r"\b(?:telephone|phone|call|helpline|contact)\s*(?:number|line)?[:\s]+(?:0[0-9]{2,4}\s*[0-9]{3,4}\s*[0-9]{3,4}|\+44)", ("phone", "call", "helpline", "contact")),
    ("i", r"\b(?:email|e-mail)[:\s]+\S+@\S+\.\S+", ("@",)),
    ("i", r"\b(?:write\s+to|post|address)[:\s]+", ("write", "post", "address")),
]
SECTION_MENTIONS = [
    r"\b(?:see|refer\s+to)\s+(?:section|paragraph|chapter)\s+([0-9.]+)",
    r"\b(?:as\s+(?:explained|described|set\s+out)\s+in)\s+(?:section|paragraph)\s+([0-9.]+)",
]
TABLE_MENTIONS = [
    r"\b(?:see|refer\s+to)\s+(?:the\s+)?table\b",
    r"\btable\s+(?:below|above|following)\b",
    r"\bthe\s+following\s+table\b",
]
PARAGRAPH_NUMBER = r"^(?:Para(?:graph)?\.?\s*)?([0-9]+(?:\.[0-9]+)*)"

# --- fixed values: amounts, rates, years, dates, forms --------------------------------------------
POUND_AMOUNT = r"£([0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]{2})?|[0-9]+(?:\.[0-9]{2})?)"
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
YEAR_SPAN = r"([0-9]{4})[/-]([0-9]{2,4})"
STATED_YEAR_SPAN = r"(?:tax\s+year|year)\s+([0-9]{4})[/-]([0-9]{2,4})"
DAY_MONTH_YEAR = r"([0-9]{1,2})\s+(" + "|".join(MONTHS) + r")\s*([0-9]{4})?"
DAY_MONTH = r"([0-9]{1,2})\s+(" + "|".join(MONTHS) + ")"
FORM_CODE = r"\b(SA[0-9]{2,3}[A-Z]?|CT[0-9]{3}|VAT[0-9]{1,3}|P[0-9]{2}[A-Z]?|P60|P45|P11D)\b"
FORM_CODE_WIDE = r"\b(SA[0-9]{2,3}[A-Z]?|CT[0-9]{3}[A-Z]?|VAT[0-9]{1,3}|P[0-9]{2}[A-Z]?|P60|P45|P11D(?:\(b\))?|RTI|FPS|EPS)\b"

FORM_NAMES = {
    "SA100": "Self Assessment tax return (main form)",
    "SA102": "Employment income",
    "SA103": "Self-employment (short)",
    "SA103F": "Self-employment (full)",
    "SA104": "Partnership",
    "SA105": "UK property income",
    "SA106": "Foreign income",
    "SA108": "Capital gains",
    "SA109": "Residence and remittance",
    "CT600": "Corporation Tax return",
    "CT600A": "Losses, deficits and excess amounts",
    "CT600B": "Controlled foreign companies",
    "VAT1": "VAT registration application",
    "VAT2": "VAT partnership details",
    "VAT100": "VAT return",
    "P60": "End of year certificate",
    "P45": "Details of employee leaving work",
    "P11D": "Expenses and benefits",
    "P11D(b)": "Return of Class 1A NI contributions",
    "RTI": "Real Time Information",
    "FPS": "Full Payment Submission",
    "EPS": "Employer Payment Summary",
}
FORM_NAME_DEFAULT = "HMRC form"

# --- fixed values: thresholds, first pattern that yields a value wins ------------------------------
THRESHOLD_PATTERNS = [
    ("vat_registration", r"(?:VAT\s+)?registration\s+threshold[:\s]+£?([0-9,]+)"),
    ("vat_registration", r"(?:taxable\s+)?turnover\s+(?:exceeds?|over|more\s+than)\s+£([0-9,]+)"),
    ("personal_allowance", r"personal\s+allowance[:\s]+£?([0-9,]+)"),
    ("personal_allowance", r"tax[- ]free\s+allowance[:\s]+£?([0-9,]+)"),
    ("basic_rate_threshold", r"basic\s+rate\s+(?:band|threshold)[:\s]+£?([0-9,]+)"),
    ("higher_rate_threshold", r"higher\s+rate\s+(?:band|threshold)[:\s]+£?([0-9,]+)"),
    ("additional_rate_threshold", r"additional\s+rate\s+(?:band|threshold)[:\s]+£?([0-9,]+)"),
    ("small_profits_threshold", r"small\s+profits\s+(?:rate|threshold)[:\s]+£?([0-9,]+)"),
    ("main_rate_threshold", r"(?:main\s+rate|upper)\s+(?:profits?\s+)?(?:limit|threshold)[:\s]+£?([0-9,]+)"),
    ("ni_primary_threshold", r"primary\s+threshold[:\s]+£?([0-9,]+)"),
    ("ni_secondary_threshold", r"secondary\s+threshold[:\s]+£?([0-9,]+)"),
    ("ni_upper_earnings", r"upper\s+earnings\s+limit[:\s]+£?([0-9,]+)"),
    ("threshold", r"threshold\s+(?:of|is)\s+£([0-9,]+)"),
    ("threshold", r"£([0-9,]+)\s+threshold"),
]

# --- fixed values: topic and business words --------------------------------------------------------
TOPIC_WORDS = {
    "vat": ["vat", "value added tax", "vat registration", "vat return", "vat rate"],
    "income_tax": ["income tax", "paye", "personal allowance", "tax band", "tax code"],
    "corporation_tax": ["corporation tax", "company tax", "ct600", "marginal relief"],
    "self_assessment": ["self assessment", "self-assessment", "sa100", "tax return"],
    "national_insurance": ["national insurance", "ni contributions", "class 1", "class 2", "class 4"],
    "capital_gains": ["capital gains", "cgt", "asset disposal", "annual exempt amount"],
    "paye": ["paye", "employer", "payroll", "real time information", "rti"],
    "penalties": ["penalty", "penalties", "late filing", "late payment", "surcharge"],
    "tax_credits": ["tax credits", "working tax credit", "child tax credit"],
    "inheritance_tax": ["inheritance tax", "iht", "estate", "nil rate band"],
}
BUSINESS_WORDS = {
    "sole_trader": ["sole trader", "self-employed", "self employed", "freelancer"],
    "limited_company": ["limited company", "ltd", "company director", "corporation"],
    "partnership": ["partnership", "partner", "llp"],
    "contractor": ["contractor", "ir35", "off-payroll"],
    "landlord": ["landlord", "property income", "rental income", "buy to let"],
    "employer": ["employer", "employee", "paye", "payroll"],
}
DATE_WORDS = [
    ("deadline", ["deadline", "due", "submit", "file"]),
    ("payment", ["pay", "payment"]),
    ("start_date", ["start", "begin", "commence"]),
    ("end_date", ["end", "finish", "close"]),
]

# --- fixed values: calendar deadlines --------------------------------------------------------------
# (key, day, month, name, type, category, applies to)
KNOWN_DEADLINES = [
    ("31 january", 31, 1, "Self Assessment Tax Return and Payment", "filing", "self_assessment",
     ["self_employed", "landlord", "high_earner"]),
    ("5 april", 5, 4, "Tax Year End", "notification", "general", []),
    ("6 april", 6, 4, "New Tax Year Start", "notification", "general", []),
    ("31 july", 31, 7, "Second Payment on Account", "payment", "self_assessment", []),
    ("31 october", 31, 10, "Paper Self Assessment Deadline", "filing", "self_assessment", []),
    ("19 april", 19, 4, "PAYE Year End Returns", "filing", "paye", []),
]
RELATIVE_DEADLINE = r"within\s+([0-9]+)\s+(days?|months?|weeks?)\s+(?:of|after|from)"
RELATIVE_DEADLINE_WORDS = [("filing", ["file", "submit"]), ("payment", ["pay"]),
                           ("registration", ["register"]), ("appeal", ["appeal"])]
PENALTY_NEAR_DATE = [
    r"penalty\s+of\s+£[0-9,]+",
    r"£[0-9,]+\s+penalty",
    r"late\s+filing\s+penalty",
    r"interest\s+will\s+be\s+charged",
]
DEADLINE_PROBE = (
    r"\b(?:deadline|due\s+date)\b|must\s+be\s+(?:filed|submitted|paid)\s+by"
    r"|within\s+[0-9]+\s+(?:days?|months?|weeks?)|[0-9]{1,2}\s+" + MONTH_WORDS
)

# --- fixed values: contacts -------------------------------------------------------------------------
PHONE_PATTERNS = [
    r"(0[0-9]{2,4}[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})",
    r"(\+44[\s.-]?[0-9]{2,4}[\s.-]?[0-9]{3}[\s.-]?[0-9]{4})",
]
EMAIL = r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
OPENING_HOURS = r"([0-9]{1,2}(?::[0-9]{2})?(?:am|pm)?[\s-]+(?:to|-)[\s-]+[0-9]{1,2}(?::[0-9]{2})?(?:am|pm)?)"
WEEKDAYS = "(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
OPENING_DAYS = r"(" + WEEKDAYS + r"[\s-]+(?:to|-)[\s-]+" + WEEKDAYS + ")"
HELPLINES = {
    "0300 200 3310": ("Self Assessment Helpline", "self_assessment"),
    "0300 200 3700": ("VAT Helpline", "vat"),
    "0300 200 3200": ("Corporation Tax Helpline", "corporation_tax"),
    "0300 200 3500": ("National Insurance Helpline", "national_insurance"),
    "0300 200 3300": ("Employer Helpline", "paye"),
    "0300 200 3600": ("Tax Credits Helpline", "tax_credits"),
}
CONTACT_DEFAULT_NAME = "HMRC Contact"
CONTACT_INDICATORS = [
    r"\bcontact\s+(?:us|hmrc)",
    r"\bhelpline\b",
    r"\btelephone\b",
    r"\bcall\s+(?:us|hmrc)",
    r"\bget\s+help\b",
    r"\bphone\s+number\b",
]

# --- fixed values: condition lists --------------------------------------------------------------------
# (type, name hint, has a subject group, pattern)
CONDITION_STARTS = [
    ("requirement", "must", True, r"you\s+(?:must|should|need\s+to)\s+([a-z]+(?:\s+[a-z]+){0,5})\s+if[:\s]+"),
    ("eligibility", "can", True, r"you\s+(?:can(?:not)?|cannot)\s+([a-z]+(?:\s+[a-z]+){0,5})\s+(?:if|unless)[:\s]+"),
    ("eligibility", "eligible", True,
     r"(?:you'?re?|you\s+are)\s+(?:only\s+)?(?:eligible|entitled)\s+(?:for\s+)?([a-z]+(?:\s+[a-z]+){0,3})?\s*if[:\s]+"),
    ("exemption", "exempt", True,
     r"(?:you'?re?|you\s+are)\s+exempt\s+(?:from\s+)?([a-z]+(?:\s+[a-z]+){0,3})?\s*if[:\s]+"),
    ("requirement", "following", False,
     r"(?:if\s+)?(?:any|all)\s+of\s+the\s+following\s+(?:conditions?\s+)?apply[:\s]+"),
]
LETTERED_ITEM = r"^\s*\(([a-z])\)\s*(.+?)(?=^\s*\([a-z]\)|\z)"
NUMBERED_ITEM = r"^\s*([0-9]+)\.\s*(.+?)(?=^\s*[0-9]+\.|\z)"
BULLET_ITEM = r"^\s*[•\-*]\s*(.+?)(?=^\s*[•\-*]|\z)"
OR_WORDS = r"\b(?:any\s+of|one\s+of|or|either)\b"
AND_WORDS = r"\b(?:all\s+of|each\s+of|and|both)\b"
OUTCOME_BY_TYPE = {
    "requirement": "You must comply with this requirement",
    "eligibility": "You are eligible",
    "exemption": "You are exempt",
}
OUTCOME_PATTERNS = [
    r"you\s+(?:must|should)\s+([a-z]+(?:\s+[a-z]+){0,3})",
    r"you\s+(?:can)\s+([a-z]+(?:\s+[a-z]+){0,3})",
]

# --- fixed values: worked examples --------------------------------------------------------------------
EXAMPLE_STARTS = [
    r"\bexample[:\s]+([A-Z][a-z]+)",
    r"\bfor\s+example[,:\s]+",
    r"\bsuppose\s+(?:that\s+)?",
    r"\blet'?s?\s+say\s+",
    r"\bconsider\s+(?:the\s+)?(?:case|following|situation)",
]
EXAMPLE_ENDS = [r"\n\n##", r"\n\nExample:", r"\n\nNote:"]
EXAMPLE_NAMES = ["Sarah", "John", "Mary", "James", "Company A", "ABC Ltd", "XYZ Ltd"]
SCENARIO_AMOUNTS = [
    ("income", r"(?:earns?|has\s+(?:income|salary)\s+of)\s+£([0-9,]+)"),
    ("income", r"(?:income|earnings?|salary)\s+(?:of\s+)?£([0-9,]+)"),
    ("turnover", r"(?:turnover|revenue)\s+(?:of\s+)?£([0-9,]+)"),
    ("profit", r"(?:profits?)\s+(?:of\s+)?£([0-9,]+)"),
]
EXAMPLE_STEP = r"(?:step\s+([0-9]+)[:\s]+|([0-9]+)\.\s+)(.+?)(?=step\s+[0-9]+|^[0-9]+\.|$)"
STEP_CALCULATION = r"(£?[0-9,]+(?:\s*[×x*+\-/]\s*[0-9,.%]+)+)"
STEP_RESULT = r"=\s*£?([0-9,]+)"
FINAL_RESULTS = [
    r"(?:total|final|overall)\s+(?:tax|amount|sum)[:\s]+£([0-9,]+)",
    r"(?:tax\s+)?(?:due|payable|liability)[:\s]+£([0-9,]+)",
    r"=\s*£([0-9,]+)",
]
EXAMPLE_CATEGORIES = [
    ("income_tax", r"\bincome\s+tax\b|\bpaye\b|\bpersonal\s+allowance\b"),
    ("corporation_tax", r"\bcorporation\s+tax\b|\bcompany\s+(?:tax|profit)|\bmarginal\s+relief\b"),
    ("vat", r"\bvat\b|\bvalue\s+added\s+tax\b"),
    ("capital_gains", r"\bcapital\s+gains?\b|\bcgt\b|\basset\s+disposal\b"),
    ("national_insurance", r"\bnational\s+insurance\b|\bnic?\b|\bclass\s+[1-4]\b"),
    ("self_assessment", r"\bself[- ]assessment\b|\bsa\s+[0-9]{3}\b"),
]
EXAMPLE_CATEGORY_TITLES = {
    "income_tax": "Income Tax",
    "corporation_tax": "Corporation Tax",
    "vat": "VAT",
    "capital_gains": "Capital Gains Tax",
    "national_insurance": "National Insurance",
}
EXAMPLE_FORMULAS = {
    "marginal relief": "Marginal Relief Formula",
    "personal allowance": "Personal Allowance Calculation",
    "tax band": "Tax Band Calculation",
}
EXAMPLE_TABLES = {"tax rate": "Tax Rates", "tax band": "Tax Bands", "threshold": "Thresholds"}

# --- fixed values: cross-references ----------------------------------------------------------------------
SECTION_REFERENCES = [
    r"(?:see|refer\s+to)\s+(?:section|paragraph|para\.?)\s+([0-9.]+)",
    r"(?:as\s+(?:explained|described|set\s+out)\s+in)\s+(?:section|paragraph)\s+([0-9.]+)",
    r"(?:section|paragraph|para\.?)\s+([0-9.]+)\s+(?:above|below|explains?)",
]
LEGISLATION_REFERENCES = [
    ("uk_act", r"((?:Finance|Tax(?:es)?|VAT|Income\s+Tax|Corporation\s+Tax)\s+Act\s+[0-9]{4})"),
    ("act_section", r"(?:section|s\.?)\s*([0-9]+[A-Z]?)\s+(?:of\s+)?(?:the\s+)?(\w+\s+Act\s+[0-9]{4})"),
    ("statutory_instrument", r"(?:SI|S\.I\.)\s*([0-9]{4}/[0-9]+)"),
    ("eu_regulation", r"(?:EU\s+)?(?:Regulation|Directive)\s+([0-9]+/[0-9]+)"),
]
TERM_REFERENCES = [
    r"['\"]([^'\"]+)['\"]\s+(?:as\s+defined|has\s+the\s+meaning|means)",
    r"(?:the\s+term\s+)?['\"]([^'\"]+)['\"]\s+is\s+defined\s+in",
    r"(?:within\s+the\s+meaning\s+of)\s+([^,.]+)",
]
RELATIONSHIP_WORDS = [
    ("references", ["see", "refer to", "explained in"]),
    ("supersedes", ["supersedes", "replaces", "replaced by"]),
    ("defines", ["defines", "definition"]),
    ("example_of", ["example", "such as"]),
]
SKIPPED_LINKS = ["/sign-in", "/register", "/search"]

# --- fixed values: formulas -----------------------------------------------------------------------------
FORMULA_PROBE = r"calculated\s+(?:as|by)|=\s*[^=]|[0-9]+/[0-9]+\s*[×x*]|formula|multiply|divide|subtract|add"
GENERIC_FORMULAS = [
    r"(?:the\s+)?(?:calculation|formula|equation)\s+is[:\s]+(.{20,200})",
    r"(?:is\s+)?calculated\s+(?:as|by)[:\s]+(.{20,200})",
    # The words before "=" are taken whole and from the start of a word: same matches, no backtracking.
    r"(?<![a-zA-Z])([A-Z][a-zA-Z\s]++)=\s*([^.]+(?:×|x|\*|/|÷|\+|-)[^.]+)",
    r"([0-9]+/[0-9]+)\s*[×x*]\s*\(([^)]+)\)",
]
MARGINAL_RELIEF = r"(?:marginal\s+relief|small\s+profits\s+rate).{0,50}(3/200|[0-9]+/[0-9]+).{0,100}"
TAX_CALCULATION = r"(?:tax\s+(?:due|payable|liability)|income\s+tax|corporation\s+tax).{0,30}(?:=|is\s+calculated).{0,150}"
PENALTY_CALCULATION = r"(?:penalty|surcharge).{0,30}(?:=|is\s+calculated|amounts?\s+to).{0,150}"
VAT_CALCULATION = r"(?:vat\s+(?:due|payable|amount)).{0,30}(?:=|is\s+calculated).{0,150}"
FORMULA_NAMES = [
    r"(?:to\s+)?calculate\s+(?:the\s+)?([a-z]+(?:\s+[a-z]+){0,2})",
    r"([a-z]+(?:\s+[a-z]+){0,2})\s+(?:is\s+)?calculated",
]
FORMULA_VARIABLES = [
    ("income", r"\b(?:income|earnings?|profits?|turnover)\b"),
    ("rate", r"\b(?:rate|percentage|%)\b"),
    ("threshold", r"\b(?:threshold|limit|allowance)\b"),
    ("period", r"\b(?:days?|months?|years?|period)\b"),
    ("amount", r"\b(?:amount|sum|total|value)\b"),
]
DEFAULT_UPPER_LIMIT = 250000
# (name, type, text, description, variables, logic, tables)
KNOWN_FORMULAS = {
    "income_tax": ("Income Tax Calculation", "tax_calculation",
                   "Income Tax = (Taxable Income - Personal Allowance) × Tax Rate",
                   ["taxable_income", "personal_allowance", "tax_rate"], "banded_calculation", "Income Tax Rates"),
    "corporation_tax": ("Corporation Tax Calculation", "tax_calculation",
                        "Corporation Tax = Taxable Profits × Corporation Tax Rate",
                        ["taxable_profits", "tax_rate"], "simple_multiplication", "Corporation Tax Rates"),
    "penalty": ("Penalty Calculation", "penalty_calculation",
                "Penalty = Base Penalty + (Daily Penalty × Days Late)",
                ["base_penalty", "daily_penalty", "days_late"], "penalty_tiered", "Penalty Schedule"),
    "vat": ("VAT Calculation", "vat_calculation", "VAT = Net Amount × VAT Rate",
            ["net_amount", "vat_rate"], "simple_multiplication", "VAT Rates"),
}

# --- fixed values: inputs of the known formulas as (name, unit, default) --------------------------------
FORMULA_INPUTS = {
    "marginal_relief": [("augmented_profits", "currency_gbp", None), ("taxable_profits", "currency_gbp", None),
                        ("upper_limit", "currency_gbp", 250000), ("fraction", "fraction", None)],
    "income_tax": [("taxable_income", "currency_gbp", None), ("personal_allowance", "currency_gbp", 12570), ("tax_rate", "percentage", None)],
    "corporation_tax": [("taxable_profits", "currency_gbp", None), ("tax_rate", "percentage", None)],
    "penalty": [("base_penalty", "currency_gbp", None), ("daily_penalty", "currency_gbp", None), ("days_late", "number", None)],
    "vat": [("net_amount", "currency_gbp", None), ("vat_rate", "percentage", 20)],
}

# --- fixed values: steps of the known formulas as (result, operation, operands) --------------------------
FORMULA_STEPS = {
    "marginal_relief": [("excess", "subtract", ["upper_limit", "augmented_profits"]), ("ratio", "divide", ["taxable_profits", "augmented_profits"]),
                        ("product", "multiply", ["excess", "ratio"]), ("relief", "multiply", ["product", "fraction"])],
    "income_tax": [("taxed", "subtract", ["taxable_income", "personal_allowance"]), ("tax", "percent", ["taxed", "tax_rate"])],
    "corporation_tax": [("tax", "percent", ["taxable_profits", "tax_rate"])],
    "penalty": [("daily_total", "multiply", ["daily_penalty", "days_late"]), ("penalty", "add", ["base_penalty", "daily_total"])],
    "vat": [("vat", "percent", ["net_amount", "vat_rate"])],
}

# --- fixed values: html tables -------------------------------------------------------------------------
TABLE_TYPES = [
    ("tax_rates", r"\brate\b|\bband\b|\btax\s+rate|\bincome\s+tax|\bcorporation\s+tax|\btaxable\s+income"),
    ("vat_rates", r"\bvat\s+rate|\bstandard\s+rate|\breduced\s+rate|\bzero[- ]rated|\bexempt"),
    ("penalties", r"\bpenalt|\bsurcharge|\bfine\b|\blate\s+filing|\blate\s+payment|\bdays?\s+late"),
    ("thresholds", r"\bthreshold|\blimit\b|\bmaximum|\bminimum|\ballowance|\bexemption\s+limit"),
    ("deadlines", r"\bdeadline|\bdue\s+date|\bfiling\s+date|\bpayment\s+date|\bsubmission"),
    ("ni_rates", r"\bnational\s+insurance|\bni\s+rate|\bclass\s+[1-4]|\bnic\b|\bemployer.{0,10}ni"),
    ("ni_thresholds", r"\bni\s+threshold|\bprimary\s+threshold|\bsecondary\s+threshold|\bupper\s+earnings"),
    ("allowances", r"\bpersonal\s+allowance|\bcapital\s+allowance|\bannual\s+allowance|\btax.free"),
    ("mileage_rates", r"\bmileage|\bapproved\s+mileage|\bbusiness\s+miles|\bpence\s+per\s+mile"),
    ("benefit_rates", r"\bbenefit\s+in\s+kind|\bbik\b|\bcompany\s+car|\bp11d"),
]
TABLE_TITLES = {
    "tax_rates": "Tax Rates",
    "vat_rates": "VAT Rates",
    "penalties": "Penalty Schedule",
    "thresholds": "Thresholds",
    "deadlines": "Deadlines",
    "ni_rates": "National Insurance Rates",
    "ni_thresholds": "National Insurance Thresholds",
    "allowances": "Allowances",
    "mileage_rates": "Mileage Rates",
    "benefit_rates": "Benefit Rates",
    "other": "Data Table",
}
LOOKUP_COLUMN = r"\bfrom\b|\bover\b|\babove\b|\bband\b|\bcategory|\btype\b|\bclass\b|\bdays?"
VALUE_COLUMN = r"\brate\b|\bamount|%|\bpenalty|\btax\b|\bpayable|\bdue\b"

# --- fixed values: labels stored for topics, tables and formulas ------------------------------------------
TOPIC_LABELS = {
    "vat": "VAT",
    "income_tax": "Income_Tax",
    "corporation_tax": "Corporation_Tax",
    "self_assessment": "Self_Assessment",
    "national_insurance": "National_Insurance",
    "capital_gains": "Capital_Gains",
    "paye": "PAYE",
    "penalties": "Penalties",
}
FORMULA_LABELS = ["marginal_relief", "tax_calculation", "penalty_calculation", "vat_calculation", "relief_calculation"]

# --- fixed values: allowed values of stored columns ---------------------------------------------------------
AUTHORITIES = ["GOV_UK", "HMRC_MANUAL", "UK_LEGISLATION", "COMPANIES_HOUSE", "ACAS", "OTHER_OFFICIAL"]
REFERENCE_STRENGTHS = ["required", "recommended", "optional"]

# Fields of a vector-store row, in order, and what stands for an empty one.
VECTOR_ROW_FIELDS = [
    "document_id", "source_url", "source_authority", "section_title", "heading_path", "section_id", "paragraph_number", "citable_reference",
    "topic_primary", "topic_secondary", "business_types", "content_type", "service_category", "reliability_tier", "tax_year", "publication_date",
    "threshold_values", "keywords", "form_references", "applies_to_tax_years", "has_outgoing_references", "has_incoming_references",
    "contains_table", "contains_formula", "contains_decision_tree", "contains_deadline", "contains_example", "contains_contact",
    "structured_content_types", "requires_professional_advice", "deadline_sensitive", "penalty_relevant", "chunk_index",
]
VECTOR_ROW_DEFAULTS = {"topic_primary": "Other", "content_type": "factual", "service_category": "none"}
