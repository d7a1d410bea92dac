"""Explicit schemas; no reader infers types."""

PERIOD = "struct<start:date,end:date,kind:string,fiscal_year:int,fiscal_period:string>"
FACTS = (
    "id string, ticker string, concept string, roles array<string>, value string, scale string, unit string,"
    f" currency string, dimensions map<string,string>, period {PERIOD}, path string, content_hash string, ordinal long"
)
FACT_INDEX = (
    "ticker string, facts array<struct<id:string,concept:string,roles:array<string>,value:string,scale:string,"
    f"unit:string,currency:string,dimensions:map<string,string>,period:{PERIOD},path:string,content_hash:string>>"
)
FILINGS = (
    "ticker string, company string, cik string, form string, fiscal_year int, filing_date date, report_date date,"
    " accession string, source_url string, source_sha256 string, page_count int, token_count int, element_count int, body string"
)
COMPANIES = (
    "ticker string, sec_ticker string, cik string, title string, exchange string, sector string, industry string"
)
PRICES = (
    "date string, open string, high string, low string, close string, adj_close string, volume string, dividend string,"
    " split_ratio string"
)
MACRO = ("date string, value string, realtime_start string, realtime_end string")
QUESTION_METRICS = (
    "question_id string, agent string, question string, total_tokens int, elapsed_ms double, provider string,"
    " model string, status string, source_vault string, source_turn int"
)
QUESTION_SET = (
    "source string, questions array<struct<id:string,title:string,"
    "subquestions:array<struct<id:string,label:string,prompt:string>>>>"
)
COMPANY_FACTS = "cik long, entityName string, facts map<string,map<string,struct<label:string,units:map<string," \
    "array<struct<start:string,end:string,val:double,accn:string,fy:int,fp:string,form:string,filed:string>>>>>>"
SUBMISSIONS = "cik string, name string, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>," \
    "filingDate:array<string>,reportDate:array<string>,primaryDocument:array<string>>," \
    "files:array<struct<name:string,filingFrom:string,filingTo:string>>>"
CHART = "chart struct<result:array<struct<timestamp:array<long>,indicators:struct<quote:array<struct<open:array<double>," \
    "high:array<double>,low:array<double>,close:array<double>,volume:array<long>>>,adjclose:array<struct<adjclose:array<double>>>>," \
    "events:struct<dividends:map<string,struct<amount:double>>,splits:map<string,struct<numerator:double,denominator:double>>>>>>"
RESULT = "ok boolean, agent string, provider string, model string, route string, answer string, cache_hit boolean," \
    " cache_kind string, sources array<string>, metrics struct<total_tokens:long,prompt_tokens:long,completion_tokens:long," \
    "total_ms:double,model_ms:double,local_ms:double,bind_ms:double,model_calls:int,usage_complete:boolean>"
