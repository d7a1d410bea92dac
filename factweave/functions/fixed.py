"""Fixed values. They decide results, so they are stated as plain text and not derived."""

# Preferred concepts of each financial role, best first.
ROLE_CONCEPTS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"],
    "operating_income": ["OperatingIncomeLoss"],
    "net_income": ["NetIncomeLoss", "ProfitLoss"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "cost_of_revenue": ["CostOfRevenue", "CostOfGoodsAndServicesSold", "CostOfGoodsSold"],
}
ANNUAL_DAYS = (350, 380)

# The two roles of each annual comparison, in reporting order.
INTENT_ROLES = {
    "cash_conversion": ("operating_cash_flow", "net_income"),
    "operating_leverage": ("revenue", "operating_income"),
    "gross_margin": ("revenue", "cost_of_revenue"),
    "operating_margin": ("revenue", "operating_income"),
    "net_margin": ("revenue", "net_income"),
}

# Wording of annual questions.
ANNUAL_VERBS = r"\b(compare|calculate|compute|show|what|how)\b"
ANNUAL_EXCLUDED = (
    r"segment|services|products|quarter|\bq[1-4]\b|ytd|capex|capital expend|free.cash|dividend|debt|forecast|why"
    r"|drivers|valuation|premium|sustain|working.capital|adjusted|non.gaap|per.share|hypothetical|assum|calendar"
    r"|as of|trailing|\bttm\b|month|january|february|march|april|may|june|july|august|september|october|november|december"
)
CASH_CONVERSION_WORDING = r"(?:cfo|operating cash flow)\s*(?:/|divided by|to)\s*net income"
INTENT_PERMITTED = {
    "cash_conversion": ["cash conversion", "operating cash flow", "net income", "cfo"],
    "operating_leverage": ["operating leverage", "incremental operating margin", "operating margin", "operating income", "revenue"],
    "gross_margin": ["gross margin", "gross profit", "cost of revenue", "cost of sales", "revenue"],
    "operating_margin": ["operating margin", "operating income", "revenue"],
    "net_margin": ["net margin", "net income", "revenue"],
}
ANNUAL_METRICS = [
    "cash conversion", "operating cash flow", "net income", "cfo", "operating leverage", "incremental operating margin",
    "operating margin", "operating income", "revenue", "gross margin", "gross profit", "cost of revenue", "cost of sales",
    "net margin", "assets", "liabilities", "equity", "interest", "ebitda", "eps",
]
YEAR_PATTERN = r"(?:\b|fy)(20\d{2})\b"
YEAR_RANGE_PATTERN = r"(?:fy)?20\d{2}\s*(?:-|–|through|to)\s*(?:fy)?20\d{2}"
MAX_YEARS = 5

# Wording of single-number questions; the first role whose term occurs wins.
SCALAR_ROLE_TERMS = [
    ("operating_cash_flow", ["operating cash flow", "cash from operations"]),
    ("cost_of_revenue", ["cost of revenue", "cost of sales", "cost of goods"]),
    ("operating_income", ["operating income", "operating profit"]),
    ("net_income", ["net income", "net profit", "earnings"]),
    ("gross_profit", ["gross profit"]),
    ("revenue", ["revenue", "sales"]),
    ("liabilities", ["liabilities"]),
    ("assets", ["assets"]),
    ("equity", ["equity"]),
    ("cash", ["cash"]),
    ("debt", ["debt"]),
    ("eps", ["eps", "earnings per share"]),
    ("shares", ["shares outstanding", "weighted average shares"]),
]
SCALAR_OPENING = r"^(what (?:is|was|are|were)|how much|how many|calculate|compute|give me|show me)\b"
SCALAR_COMPOSITE = (
    r"\b(why|durable|quality|generation|conversion|driven|drivers|explain|outlook|translat\w*|suggest\w*|depend\w*"
    r"|risk\w*|sustain\w*|versus|compare|and|or)\b"
)
GROWTH_TERMS = ["growth", "grew", "change", "yoy", "year over year"]
QUARTER_TERMS = ["quarter", "quarterly", "q1", "q2", "q3", "q4"]

# Question classes, first match wins: name, label, terms, chain, reason.
QUESTION_CLASSES = [
    ("margin-lookup", "Margin lookup", ["margin", "gross margin", "operating margin"],
     ["delegator", "markdown-traversal", "margin-lookup", "source-lookup"],
     "The question asks for a margin-style relationship between reported numbers."),
    ("period-comparison", "Period comparison",
     ["compare", "versus", "vs", "change", "yoy", "year over year", "prior period"],
     ["delegator", "markdown-traversal", "period-comparison", "source-lookup"],
     "The question asks for period movement or year-over-year context."),
    ("ratio-reconstruction", "Ratio reconstruction", ["ratio", "percent", "percentage", "per share", "eps"],
     ["delegator", "markdown-traversal", "ratio-reconstruction", "source-lookup"],
     "The question asks for a computed ratio or percentage."),
    ("source-lookup", "Source lookup", ["source", "sec", "pdf", "filing", "document"],
     ["delegator", "source-lookup"],
     "The question explicitly asks for provenance or SEC source material."),
]
DEFAULT_CLASS = ("markdown-traversal", "Markdown traversal", ["delegator", "markdown-traversal", "source-lookup"],
                 "The question is best handled by traversing the current note and its linked evidence.")
COMPARISON_TERMS = ["compare", "comparison", "versus", " vs ", "relative to", "against", "than"]
PRICE_GROWTH_TERMS = ["stock growth", "stock performance", "share price", "price growth", "return", "returns", "last year"]
PRICE_TERMS = ["stock", "share", "price", "return", "growth", "performance"]
INVESTMENT_TERMS = ["good stock", "invest", "investment", "buy", "hold", "sell", "valuation", "bull", "bear"]
MARKET_PATTERN = r"price|worth|market.cap|valuation|buy|return"
SOURCE_TERMS = ["source", "sec", "pdf", "filing", "document"]

# Company names and symbols in questions.
COMMON_NAMES = {
    "alphabet": "GOOGL", "google": "GOOGL", "amazon": "AMZN", "apple": "AAPL", "berkshire": "BRK.B",
    "facebook": "META", "meta": "META", "microsoft": "MSFT", "nvidia": "NVDA", "tesla": "TSLA",
}
WORD_TICKERS = ["A", "T", "ALL", "ARE", "IT", "ON", "SO", "OR", "COST", "LOW", "NOW", "FAST", "NET"]
LEGAL_SUFFIXES = r"\b(inc|incorporated|corp|corporation|co|company|plc|ltd|limited|class|common|stock)\b"
ALIAS_STOP_WORDS = ["the", "new", "old"]
MAX_MENTIONS = 4

# Terms of a question used for text ranking.
TERM_STOP_WORDS = [
    "about", "after", "against", "and", "are", "between", "did", "does", "for", "from", "have", "how", "into", "its",
    "the", "their", "this", "was", "what", "when", "with",
]
CASH_TERMS = ["operating activities", "capital expenditures", "property and equipment", "net income",
              "working capital", "stock-based", "depreciation", "free cash flow"]
SEGMENT_TERMS = ["segment", "revenue", "operating income"]
INVESTMENT_EXTRA_TERMS = ["revenue", "sales", "income", "margin", "cash", "debt", "eps", "risk", "competition",
                          "liquidity", "capital", "repurchase"]
MAX_TERMS = 18

# Fact scoring for linked evidence.
FACT_SCORE_WORDS = ["revenue", "sales", "cost", "gross", "margin", "operating", "income", "expense", "profit", "cash",
                    "debt", "asset", "liabil", "share", "eps"]

# Label scores of structured filing facts, first match wins.
LABEL_SCORES = [
    (r"(?i)revenue|net sales", 90),
    (r"(?i)net income", 85),
    (r"(?i)operating income|gross margin", 80),
    (r"(?i)cash|marketable securities|assets|liabilities|debt|commercial paper", 70),
    (r"(?i)earnings per share|dividends?|share repurchases?", 60),
    (r"(?i)research and development", 50),
]
LABEL_WANTED = [
    "net sales", "revenue", "net income", "operating income", "gross margin", "earnings per share",
    "cash.*equivalents", "marketable securities", "total assets", "total liabilities", "term debt", "commercial paper",
    "research and development", "share repurchases?", "dividends?",
]
LABEL_EXCLUDED = ["remaining performance obligation", "contract liability revenue", "deferred revenue percentage"]
TEXT_FACT_PATTERN = r"(?i)(risk factors?|competition|liquidity|capital resources|business|products|services)"

# Web sources.
FINANCIAL_SOURCE_PATTERN = (
    r"(?i)cash.flow|revenue|earnings|financial|income|capex|profit|valuation|market.cap|stock.price|annual.report|10-[kq]"
)

# Sectors by ticker symbol.
SECTOR_TICKERS = {
    "Communication Services": ["CMCSA", "DIS", "GOOG", "GOOGL", "META", "NFLX", "T", "TMUS", "VZ"],
    "Consumer Discretionary": ["AMZN", "BKNG", "GM", "HD", "LOW", "MCD", "NKE", "SBUX", "TSLA"],
    "Consumer Staples": ["CL", "COST", "KO", "MDLZ", "MO", "PEP", "PG", "PM", "WMT"],
    "Energy": ["COP", "CVX", "XOM"],
    "Financials": ["AXP", "BAC", "BLK", "BNY", "BRK-B", "C", "COF", "GS", "JPM", "MA", "MS", "SCHW", "USB", "V", "WFC"],
    "Health Care": ["ABBV", "ABT", "AMGN", "BMY", "CVS", "DHR", "GILD", "ISRG", "JNJ", "LLY", "MDT", "MRK", "PFE", "TMO", "UNH"],
    "Industrials": ["BA", "CAT", "DE", "EMR", "FDX", "GD", "GE", "GEV", "HONA", "LMT", "MMM", "RTX", "UBER", "UNP", "UPS"],
    "Information Technology": ["AAPL", "ACN", "ADBE", "AMAT", "AMD", "AVGO", "CRM", "CSCO", "IBM", "INTC", "INTU", "LRCX", "MSFT", "MU", "NOW", "NVDA", "ORCL", "PLTR", "QCOM", "TXN"],
    "Materials": ["LIN"],
    "Real Estate": ["AMT", "SPG"],
    "Utilities": ["DUK", "NEE", "SO"],
}
SECTOR_ACTIVITY = {
    "Communication Services": "provides communications, media, entertainment, advertising, or digital platform services",
    "Consumer Discretionary": "provides consumer products or services such as retail, travel, restaurants, vehicles, or apparel",
    "Consumer Staples": "provides everyday consumer products such as food, beverages, household goods, or essential retail",
    "Energy": "produces, refines, transports, or markets energy products",
    "Financials": "provides banking, payments, investment, insurance, or other financial services",
    "Health Care": "provides medicines, medical technology, diagnostics, or health-related services",
    "Industrials": "provides industrial equipment, transportation, aerospace, engineering, or commercial services",
    "Information Technology": "develops or provides technology products, software, semiconductors, or IT services",
    "Materials": "produces industrial gases, chemicals, or other foundational materials",
    "Real Estate": "owns, operates, or finances income-producing real estate",
    "Utilities": "generates or distributes electricity and other utility services",
}

# Macro series by group.
MACRO_SERIES = {
    "growth": ["GDP", "GDPC1", "A191RL1Q225SBEA", "GDI", "INDPRO", "CAPUTLG2211S", "TCU"],
    "inflation": ["CPIAUCSL", "CPILFESL", "PCEPI", "PCEPILFE", "GDPDEF", "T5YIE", "T10YIE", "EXPINF1YR", "EXPINF10YR"],
    "labor": ["UNRATE", "U6RATE", "PAYEMS", "MANEMP", "ICSA", "CCSA", "CIVPART", "EMRATIO", "JTSJOL", "AHETPI", "CES0500000003"],
    "rates": ["FEDFUNDS", "SOFR", "DGS1MO", "DGS3MO", "DGS1", "DGS2", "DGS5", "DGS10", "DGS30", "T10Y2Y", "T10Y3M", "DFF", "IORB", "MORTGAGE30US"],
    "credit": ["BAMLC0A0CM", "BAMLH0A0HYM2", "NFCI", "STLFSI4", "DRTSCILM", "BUSLOANS", "TOTCI", "M2SL"],
    "consumer_housing": ["RSAFS", "PCE", "DSPIC96", "PSAVERT", "UMCSENT", "HOUST", "PERMIT", "CSUSHPINSA", "MSPUS"],
    "markets_fx_commodities": ["SP500", "NASDAQCOM", "DJIA", "VIXCLS", "DTWEXBGS", "DEXUSEU", "DEXJPUS", "DCOILWTICO", "DCOILBRENTEU", "DHHNGSP", "GOLDAMGBD228NLBM"],
    "trade_fiscal": ["NETEXP", "EXPGS", "IMPGS", "BOPGSTB", "FYFSD", "GFDEBTN", "GFDEGDQ188S", "WALCL"],
}

# Empty markers of displayed grids.
EMPTY_GRID_VALUES = ["", "-", "—", "–", "n/a", "na", "null", "none"]

# Edge kinds kept per node type, and the count kept so far below which an edge may still enter.
EDGE_RULES = {
    "finance.entity": ([], {"has_filing": 40}),
    "bundle_view": (["covers", "entity"], {"includes": 16}),
    "finance.filing": (["filed_by", "entity", "prior_filing", "next_filing", "amends", "has_bundle"],
                       {"reports": 30, "has_source": 30, "has_constraint": 30}),
    "finance.fact": (["reported_in", "sourced_from", "prior_period", "next_period"], {}),
    "finance.constraint": ([], {"*": 10}),
    "*": ([], {"*": 8}),
}
CONTEXT_RELS = {"finance.entity": "has_filing", "bundle_view": "covers", "finance.source": "belongs_to", "finance.fact": "reported_in"}
LINKED_FACT_RELS = ["reports", "includes", "constrains", "component", "prior_period", "next_period"]
LINKED_SOURCE_RELS = ["sourced_from", "has_source", "belongs_to"]

# Reuse of research, seconds.
REUSE_SECONDS = 900
REUSE_SECONDS_WARNED = 60

# Keys never stored with a result.
SECRET_KEYS = ["api_key", "authorization", "headers"]

# Filing tables: marks, scale words and wording patterns.
INVISIBLE = "\u200b\ufeff\u2060"
ASCII_BLANKS = "\t\n\x0b\x0c\r "
NOT_PLAIN = r"(?U)[*_`<]|\s\s|[^\S ]"
TOKEN_CELLS = ["$", "(", ")", ",", "%"]
DASHES = ["—", "–", "-"]
SCALE_WORDS = r"thousands?|millions?|billions?|trillions?"
SCALE_LETTERS = {"thousand": "K", "million": "M", "billion": "B", "trillion": "T"}
SCALE_PATTERNS = [
    rf"(?i)\b(?:amounts?\s+|dollars?\s+|shares?\s+)?in\s+({SCALE_WORDS})\b",
    rf"(?i)\b({SCALE_WORDS})\s+of\s+(?:dollars?|shares?)\b",
    rf"(?i)\(\s*\$?\s*({SCALE_WORDS})\s*\)",
]
UNITS_CELL = (
    rf"(?i)^\(?\s*(?:(?:amounts?|dollars?|shares?)\s+)?in\s+(?:{SCALE_WORDS})"
    rf"(?:\s+of\s+(?:dollars?|shares?))?(?:\s*,?\s*except\b.+)?\s*\)?$"
)
UNITS_EXCEPTION_CLAUSE = (
    rf"(?i)\(?\s*(?:(?:amounts?|dollars?|shares?)\s+)?in\s+(?:{SCALE_WORDS})"
    rf"(?:\s+of\s+(?:dollars?|shares?))?\s*,?\s*except\b[^)]*(?:\)|$)"
)
ZERO_THOUSANDS = r"(?i)\(\s*0{3}(?:['’]?s)?\s*\)"
SHARE_SCALE_PATTERNS = [
    rf"\b(?:number\s+of\s+)?shares?[^.;:|)]{{0,90}}?(?:reflected\s+|reported\s+)?in\s+({SCALE_WORDS})\b",
    rf"\b({SCALE_WORDS})\s+of\s+shares?\b",
]
CELL_TAIL = r"(\s*[KMBT])?(\s*(?:\([A-Za-z0-9]+\)|\[[^\]]+\]|\*+))?\s*$"
CELL_VALUE = r"(?i)^(\s*(?:[-+]\s*)?(?:[$€£]\s*)?)(\d[\d,]*(?:\.\d+)?)" + CELL_TAIL
CELL_YEAR = r"(?i)^(?:19|20)\d{2}" + CELL_TAIL
CELL_CURRENCY = r"(?i)^\s*(?:[-+]\s*)?[$€£]\s*\d[\d,]*(?:\.\d+)?" + CELL_TAIL
PERCENT = r"(?i)%|\bpercent(?:age)?s?\b|\bbasis\s+points?\b|\bbps\b"
PER_SHARE = r"(?i)\bper[ -]?share\b|\bper\s+common\s+share\b|\beps\b"
TIME_METRIC = (
    r"(?i)\b(?:contractual\s+life|remaining\s+life|expected\s+term|term\s+in\s+years|"
    r"maturity\s+date|expiration\s+date|grant\s+date|fiscal\s+period)\b"
)
CHANGE_COLUMN = r"(?i)(?:%\s*)?\bchange\b|\bvariance\b"
SHARE_COUNT = (
    r"(?i)\b(?:number\s+of\s+shares|shares\s+(?:used|purchased|outstanding|subject|acquired|"
    r"issued|vested|nonvested)|share\s+count|stock\s+units?|"
    r"(?:full[ -]value\s+)?awards?\s+(?:granted|outstanding|issued|vested))\b"
)
MONETARY = (
    r"(?i)\b(?:revenue|sales|income|expense|cost|profit|loss|cash|asset|liabilit|equity|"
    r"capital|debt|loan|deposit|receivable|payable|inventory|securit|investment|"
    r"tax|fee|compensation|dividend|earnings|margin|value|amount|proceeds|aum|auc)\w*\b"
)
RATIO_WORDS = r"(?i)\b(?:ratios?|margins?|rates?|yields?|returns?|rotce|roe|roa)\b"
RATIO_RELATION = (
    r"(?i)\b(?:allowance|loans?|assets?|capital|income|loss(?:es)?|exposure|debt|equity)\b"
    r".*\bto\b.*"
    r"\b(?:allowance|loans?|assets?|capital|income|loss(?:es)?|exposure|debt|equity)\b"
)
RANKING_WORDS = r"(?i)\b(?:rank|ranked|ranking|quartile|star)\b"
EMPLOYEE_WORDS = r"(?i)\b(?:employees?|advisors?|headcount|personnel)\b"
EXCEPT_CLAUSE = r"(?i)\bexcept\b(.{0,180})"
EXCEPTION_TERMS = {
    "per_share": r"(?i)per[ -]?share|per common share",
    "percentage": r"(?i)percent|percentage|basis point|\bbps\b",
    "ratio": r"(?i)ratio|margin|rate|yield|return",
    "ranking": r"(?i)rank|quartile|star",
    "employee": r"(?i)employee|advisor|headcount|personnel",
    "time": r"(?i)contractual life|years?|months?|days?",
}
# Every match of a pattern has one of these words, in lower case.
WORDS_OF = {
    "SCALE_WORDS": ["illion", "thousand"], "SHARE_COUNT": ["share", "stock", "award"], "PER_SHARE": ["share", "eps"], "PERCENT": ["%", "percent", "basis", "bps"],
    "TIME_METRIC": ["life", "term", "date", "fiscal"], "CHANGE_COLUMN": ["change", "variance"],
}
DOLLAR_WORDING = r"(?i)\b(?:dollars?|[$€£])\b"
ACCOUNTING_PERCENT = r"^\(\s*([+-]?[\d,]+(?:\.\d+)?)\s*\)\s*(%)$"
ACCOUNTING_NUMBER = r"^([$€£])?\s*\(\s*([$€£])?\s*([+-]?[\d,]+(?:\.\d+)?)\s*\)$"
ACCOUNTING_OPEN = r"^([$€£])?\s*\(\s*([$€£])?\s*([+-]?[\d,]+(?:\.\d+)?)\s*$"
ACCOUNTING_TRAILING = r"([$€£])\s*\(\s*([+-]?[\d,]+(?:\.\d+)?)\s*$"
CLOSING_TOKEN = r"^\)\s*(%)?$"
NUMBER_FRAGMENT = r"^[+-]?\d+(?:\.\d+)?$"
DELIMITER_CELL = r"^:?-{3,}:?$"
CONTEXT_LINES = 8

# fixed values: the text of a finite number
NUMBER_TEXT = r"^([+-]?)([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]{1,4}))?$"
# Values and scales whose product always fits an amount: 19 and 6 digits, 4 and 3 digits before and after the point.
PLAIN_VALUE = r"^[+-]?[0-9]{1,19}(?:[.][0-9]{1,6})?\z"
PLAIN_SCALE = r"^[+-]?[0-9]{1,4}(?:[.][0-9]{1,3})?\z"

# fixed values: dates, accession numbers, forms and fiscal years in texts and file names
ISO_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"
NAMED_DATE = r"\b([A-Za-z]+ \d{1,2})(?:st|nd|rd|th)?[,]? (20\d{2})\b"
FISCAL_YEAR_NAME = r"(?:^|[-_])FY(\d{4})(?:[-_]|$)"
ACCESSION_NAME = r"(\d{10}-\d{2}-\d{6})"
FORM_NAME = r"(?i)-(10-K|10-Q|8-K|DEF-14A)(?:-|\.)"

# fixed values: marks that a preview leaves out, in order, and what stays of them
PREVIEW_MARKS = [
    (r"```[\s\S]*?```", " "),
    (r"(?m)^#+\s*", ""),
    (r"\[\[([^\]]+)\]\]", "$1"),
    ("`([^`]+)`", "$1"),
    (r"\n{2,}", "\n"),
    (r"^\s+|\s+$", ""),
]

# fixed values: wording of the annual programs, the first that fits counts
ANNUAL_INTENT_PHRASES = [
    ("operating_leverage", ["incremental operating margin", "operating leverage"]),
    ("gross_margin", ["gross margin"]),
    ("operating_margin", ["operating margin"]),
    ("net_margin", ["net margin"]),
]
EQUITY_WORDING = r"\bequity[- ](?:research|analyst)\b"

# fixed values: the score of a fact in an excerpt
FACT_RANK_BASE = 10
FACT_RANK_TERM = 60
FACT_RANK_CONSOLIDATED = 25
FACT_RANK_KEY_FACT = 15
FACT_RANK_MOST_YEARS = 30

# fixed values: sections and records of text facts in a structured filing
TEXT_FACTS_START = "text_facts:"
TEXT_FACTS_END = "calculation_relationships:"
TEXT_FACT_RECORD = r'(\n\s{4}label:\s*"[^"]+"[\s\S]{0,900}?\n\s{4}value:\s*"(?:[^"\\]|\\.)*")'
TEXT_FACT_LABEL = r'label:\s*"([^"]+)"'
TEXT_FACT_VALUE = r'\n\s{4}value:\s*"((?:[^"\\]|\\.)*)"'

#: Relations that link companies with their filings.
COMPANY_FILING_RELS = ["has_filing", "filed_by"]
