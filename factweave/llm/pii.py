"""Personal data and secrets replaced by format-preserving pseudonyms, in DataFrame expressions only.

Validated values are permuted by a keyed Feistel network inside their own format: two halves are added to a keyed
hash of each other, in turn, modulo the size of each half. That is one to one, so equal values become equal pseudonyms in
every document and different ones stay different; without the key none can be told from another.

* card numbers (13 to 19 digits that pass the Luhn test): all but the last digit, which is computed anew
* phone numbers: the last ten digits, whatever the signs between them; a country code stays
* social security numbers: their nine digits
* dates (existing days from 1700 to 2099, year first or last): the day's number among the 146,097 days of the four centuries
* IPv4 addresses: their 32 bits
* e-mail addresses (before the @) and secrets (access keys, values of password, token, secret and key settings): each letter or digit inside its class

Defined results: a null text stays null, an empty one empty; a value that fails its test stays (a card number with a wrong
check digit, 30 February); equal rows get equal results; other columns are kept by ``pseudonymised`` and not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: A key for tests and examples; pass your own.
EXAMPLE_KEY = "change me"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\d+])\+\d{1,3}[ .-]?\d{10}(?!\d)"
SECRET = r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Z])|(?i:password|passwd|secret|token|api_?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_.-]{8,}"
ANY = "|".join([EMAIL, IP, DATE, SSN, SECRET, PHONE, CARD])
#: Text without any of these can hold none of the above.
HINT = "[0-9@]|AKIA|(?i:password|passwd|secret|token|key)"
KINDS = ["email", "ip", "date", "ssn", "secret", "phone", "card"]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Feistel:
    """SQL expressions of one key."""

    def __init__(self, key: str) -> None:
        self.key = _sql(key)

    def halves(self, kind: str, left: str, right: str, a: str, b: str, finish: str) -> str:
        """Permutes (left, right) within (a, b); finish is an expression over s.l and s.r."""
        f = lambda x, m: f"cast(conv(substr(sha2(concat_ws('|', {self.key}, '{kind}', i, {a}, {b}, {x}), 256), 1, 15), 16, 10) AS bigint) % {m}"
        return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, i) -> "
                f"if(i % 2 = 1, named_struct('l', (s.l + {f('s.r', a)}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l', b)}) % {b})), s -> {finish})")

    def digits(self, kind: str, d: str) -> str:
        """A digit string as one of the same length (up to 20)."""
        u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
        size = lambda n: f"cast(power(10, {n}) AS bigint)"
        return self.halves(kind, f"coalesce(nullif(substr({d}, 1, {u}), ''), '0')", f"substr({d}, {u} + 1)", size(u), size(v), f"concat(if({u} = 0, '', lpad(cast(s.l AS string), {u}, '0')), lpad(cast(s.r AS string), {v}, '0'))")

    def ip(self, v: str) -> str:
        o = [f"cast(split({v}, '[.]')[{k}] AS bigint)" for k in range(4)]
        return self.halves("ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536L", "65536L", "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)")

    def day(self, d: str) -> str:
        """A date from 1700 to 2099 as another one; 146,097 days = 189 * 773."""
        n = f"datediff({d}, DATE'1700-01-01')"
        return self.halves("date", f"{n} div 773", f"{n} % 773", "189L", "773L", "date_add(DATE'1700-01-01', cast(s.l * 773 + s.r AS int))")

    def string(self, v: str) -> str:
        """Letters and digits inside their class; other characters stay."""
        u = f"(length({v}) div 2)"
        step = "cast(conv(substr(t, 1 + 2 * cast(j % 32 AS int), 2), 16, 10) AS int)"
        classes = [("0", "9"), ("a", "f"), ("g", "z"), ("A", "F"), ("G", "Z")]  # so hexadecimal text stays hexadecimal, other text other
        cases = [f"WHEN c BETWEEN '{x}' AND '{y}' THEN chr({ord(x)} + (ascii(c) - {ord(x)} + {step}) % {ord(y) - ord(x) + 1})" for x, y in classes]
        moved = f"CASE {' '.join(cases)} ELSE c END"
        shift = lambda x, y: f"array_join(transform(array(sha2(concat_ws('|', {self.key}, 'text', i, {y}), 256)), t -> array_join(transform(filter(split({x}, ''), c -> c <> ''), (c, j) -> {moved}), '')), '')"
        return (f"aggregate(sequence(1, {ROUNDS}), named_struct('l', substr({v}, 1, {u}), 'r', substr({v}, {u} + 1)), (s, i) -> "
                f"if(i % 2 = 1, named_struct('l', {shift('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {shift('s.r', 's.l')})), s -> concat(s.l, s.r))")


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _put(v: str, digits: str, kept: str = "0") -> str:
    """The characters of v with its digits, from number kept + 1 on, replaced in order."""
    seen = f"length(regexp_replace(substr({v}, 1, k), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({v})), k -> if(substr({v}, k, 1) rlike '[0-9]' AND {seen} > {kept}, substr({digits}, {seen} - {kept}, 1), substr({v}, k, 1))), '')"


def _luhn(d: str, doubled: int) -> str:
    """Luhn sum of a digit string; doubled: 0 if the last digit counts twice, 1 if the one before it does."""
    x = f"cast(substr({d}, k, 1) AS int)"
    twice = f"(length({d}) - k) % 2 = {doubled}"
    return f"aggregate(sequence(1, length({d})), 0, (t, k) -> t + if({twice}, {x} * 2 - if({x} > 4, 9, 0), {x}))"


def _kind(v: str) -> str:
    """The kind of a match, NULL if it fails its test."""
    d = f"regexp_replace({v}, '[^0-9]', '')"
    whole = lambda p: f"{v} rlike {_sql('^(?:' + p + ')$')}"
    return (f"CASE WHEN {whole(EMAIL)} THEN 'email' WHEN {whole(IP)} THEN 'ip' WHEN {whole(DATE)} THEN if({_date(v)} BETWEEN DATE'1700-01-01' AND DATE'2099-12-31', 'date', NULL) "
            f"WHEN {whole(SSN)} THEN 'ssn' WHEN {whole(SECRET)} THEN 'secret' WHEN {whole(PHONE)} THEN 'phone' WHEN {_luhn(d, 1)} % 10 = 0 THEN 'card' END")


def _date(v: str) -> str:
    p = f"split({v}, '[./-]')"
    iso = lambda y, m, d: f"try_to_date(concat_ws('-', {p}[{y}], lpad({p}[{m}], 2, '0'), lpad({p}[{d}], 2, '0')), 'yyyy-MM-dd')"
    return f"if({v} rlike '^[0-9]{{4}}-', {iso(0, 1, 2)}, coalesce({iso(2, 1, 0)}, {iso(2, 0, 1)}))"


def pseudonym(value: str, kind: str, key: str) -> str:
    """SQL of the pseudonym of ``value`` (SQL text), whose kind is the SQL text ``kind``."""
    f, v = _Feistel(key), value
    d = f"regexp_replace({v}, '[^0-9]', '')"
    phone = _let(d, "d", _let(f.digits("phone", "right(d, 10)"), "n", _put(v, "n", "(length(d) - 10)")))
    card = _let(f"substr({d}, 1, length({d}) - 1)", "d", _let(f.digits("card", "d"), "b", _let(f"concat(b, (10 - {_luhn('b', 0)} % 10) % 10)", "n", _put(v, "n"))))
    ssn = _let(f.digits("ssn", d), "n", _put(v, "n"))
    first = lambda y: f"if(try_to_date(concat_ws('-', split({v}, '[./]')[2], lpad(split({v}, '[./]')[1], 2, '0'), lpad(split({v}, '[./]')[0], 2, '0')), 'yyyy-MM-dd') IS NULL, date_format({y}, concat('MM', substr(regexp_replace({v}, '[0-9]', ''), 1, 1), 'dd', substr(regexp_replace({v}, '[0-9]', ''), 2, 1), 'yyyy')), date_format({y}, concat('dd', substr(regexp_replace({v}, '[0-9]', ''), 1, 1), 'MM', substr(regexp_replace({v}, '[0-9]', ''), 2, 1), 'yyyy')))"
    date = _let(f.day(_date(v)), "y", f"if({v} rlike '^[0-9]{{4}}-', date_format(y, 'yyyy-MM-dd'), {first('y')})")
    email = f"concat({f.string(f'''substring_index({v}, '@', 1)''')}, '@', substring_index({v}, '@', -1))"
    value_of = f"if({v} LIKE 'AKIA%', substr({v}, 5), regexp_extract({v}, {_sql('[A-Za-z0-9+/_.-]+$')}, 0))"
    secret = _let(value_of, "x", f"concat(substr({v}, 1, length({v}) - length(x)), {f.string('x')})")
    cases = {"email": email, "ip": f.ip(v), "date": date, "ssn": ssn, "secret": secret, "phone": phone, "card": card}
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in cases.items()) + f" ELSE {v} END"


def pseudonymised(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """docs with its text pseudonymised, and a column ``_pii``: kinds of the values replaced, in order."""
    matches = f"CASE WHEN `text` rlike {_sql(HINT)} THEN regexp_extract_all(`text`, {_sql(ANY)}, 0) ELSE array() END"
    kinds = f"transform({matches}, v -> named_struct('v', v, 'kind', {_kind('v')}))"
    gone = docs.select("*", F.expr(kinds).alias("_found"))
    # a generator pins the matches: read several times below, found once
    gone = gone.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(F.col("_found")))))
    swapped = f"transform(`_found`, m -> {pseudonym('m.v', 'm.kind', key)})"
    text = f"CASE WHEN exists(`_found`, m -> m.kind IS NOT NULL) THEN array_join(zip_with(split(`text`, {_sql(ANY)}, -1), {swapped}, (a, b) -> concat(a, coalesce(b, ''))), '') ELSE `text` END"
    cols = [F.expr(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return gone.select(*cols, F.expr("transform(filter(`_found`, m -> m.kind IS NOT NULL), m -> m.kind)").alias("_pii"))


def pii(docs: DataFrame, key: str = EXAMPLE_KEY) -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, n_replaced, and a count for each kind."""
    out = pseudonymised(docs.select("doc_id", "text"), key)
    count = lambda k: F.size(F.filter("_pii", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("_pii").cast("long").alias("n_replaced"), *[count(k) for k in KINDS])
