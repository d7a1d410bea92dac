"""Filing tables in plain Python: what a worker does with the lines of one document.

The patterns are those of ``fixed`` and mean what they mean in ``cells``. Without flags Java's classes and cases are ASCII, but its
``\\b`` knows the letters and digits of all scripts: words are searched in texts that are not ASCII by their ``shadow``.

A document is a list of segments, and each step gives its segments more fields; a segment is a tuple (or row) in the order of
``operators/tables.py``. Steps read segments by position.
"""

from __future__ import annotations

import re
import unicodedata

from factweave.functions import fixed

#: Blanks of all scripts, as ``\\s`` under ``(?U)``.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_HIDDEN = dict.fromkeys(map(ord, fixed.INVISIBLE))
_NOT_PLAIN = re.compile(f"[*_`<]|[{BLANKS}][{BLANKS}]|[{BLANKS.replace(' ', '')}]")
_BLANKS = re.compile(f"[{BLANKS}]+")
_BREAK, _MARKS = re.compile("<br/?>"), re.compile("[*_`]")


class _Shadow(dict):
    """Stand-ins of the characters that are not ASCII: a letter, a sign, or a mark that belongs to the letter before it."""

    def __missing__(self, code: int) -> str:
        kind = unicodedata.category(chr(code))
        self[code] = to = chr(code) if code < 128 or chr(code) in "€£" else "ж" if kind[0] == "L" or kind == "Nd" else "\u0301" if kind == "Mn" else "§"
        return to


_SHADOW = _Shadow()


def shadow(text: str) -> str:
    """A text of the same length, in which word boundaries lie where Java's do and only ASCII letters have two cases."""
    text = text.translate(_SHADOW)
    if "\u0301" in text:
        text = re.sub("([A-Za-z0-9ж])(\u0301+)", lambda m: m[1] + "ж" * len(m[2]), text).replace("\u0301", "§")
    return text


class Words:
    """A pattern with word boundaries: all methods take any text and tell places in it."""

    def __init__(self, pattern: str) -> None:
        self.ascii = re.compile(pattern, re.ASCII)
        self.other = re.compile(pattern.replace(r"\s", r"[ \t\n\x0b\f\r]").replace(r"\d", "[0-9]").replace(r"\w", "[A-Za-z0-9_]"))

    def search(self, text: str) -> re.Match | None:
        return self.ascii.search(text) if text.isascii() else self.other.search(shadow(text))

    def all(self, text: str) -> list[re.Match]:
        return [*(self.ascii.finditer(text) if text.isascii() else self.other.finditer(shadow(text)))]

    def without(self, text: str) -> str:
        """The text without the matches."""
        end, kept = 0, []
        for m in self.all(text):
            kept.append(text[end : m.start()])
            end = m.end()
        return "".join(kept) + text[end:]


# those that begin with ^ are matched, not searched
_cell = lambda pattern: re.compile(pattern, re.ASCII)
VALUE, YEAR, CURRENCY, DELIMITER = _cell(fixed.CELL_VALUE), _cell(fixed.CELL_YEAR), _cell(fixed.CELL_CURRENCY), _cell(fixed.DELIMITER_CELL)
ACCOUNTING_PERCENT, ACCOUNTING_NUMBER, ACCOUNTING_OPEN, ACCOUNTING_TRAILING = map(_cell, (fixed.ACCOUNTING_PERCENT, fixed.ACCOUNTING_NUMBER, fixed.ACCOUNTING_OPEN, fixed.ACCOUNTING_TRAILING))
CLOSING, FRAGMENT, ZERO_THOUSANDS, DIGIT = _cell(fixed.CLOSING_TOKEN), _cell(fixed.NUMBER_FRAGMENT), _cell(fixed.ZERO_THOUSANDS), _cell(r"\d")
SIGNED_SYMBOL, ENDS_IN_PERCENT, MINUS = _cell(r"^-?[$€£]"), _cell(r"%\s*$"), _cell(r"^(-?)\s*")
UNITS, UNITS_EXCEPTION, MONETARY, EXCEPT, DOLLARS = Words(fixed.UNITS_CELL), Words(fixed.UNITS_EXCEPTION_CLAUSE), Words(fixed.MONETARY), Words(fixed.EXCEPT_CLAUSE), Words(fixed.DOLLAR_WORDING)
SHARE_COUNT, PER_SHARE, PERCENT, TIME_METRIC, CHANGE = Words(fixed.SHARE_COUNT), Words(fixed.PER_SHARE), Words(fixed.PERCENT), Words(fixed.TIME_METRIC), Words(fixed.CHANGE_COLUMN)
RATIO, RELATION, RANKING, EMPLOYEE = Words(fixed.RATIO_WORDS), Words(fixed.RATIO_RELATION), Words(fixed.RANKING_WORDS), Words(fixed.EMPLOYEE_WORDS)
SCALES, SHARE_SCALES = [Words(p) for p in fixed.SCALE_PATTERNS], [Words(f"(?is){p}") for p in fixed.SHARE_SCALE_PATTERNS]
EXCEPTIONS = {n: Words(p) for n, p in fixed.EXCEPTION_TERMS.items()}
TOKENS, DASHES, OPENING = frozenset(fixed.TOKEN_CELLS), frozenset(fixed.DASHES), frozenset("$(")


# ---- cells -----------------------------------------------------------------------------------------------------------


def strip(c: str) -> str:
    return c.strip(fixed.ASCII_BLANKS) if c.isascii() else c.strip(BLANKS)


def clean(c: str) -> str:
    return c.strip(fixed.ASCII_BLANKS) if c.isascii() else c.translate(_HIDDEN).strip(BLANKS)


def plain(c: str) -> str:
    """Cell text without breaks, emphasis marks and repeated blanks."""
    t = clean(c)
    if t.isascii() and t.isprintable() and not ("  " in t or "*" in t or "_" in t or "<" in t or "`" in t):
        return t
    return _BLANKS.sub(" ", _MARKS.sub("", _BREAK.sub(" ", t))).strip(" ") if _NOT_PLAIN.search(t) else t


def mentions(low: str, kind: str) -> bool:
    """Whether a text in lower case has any of the words without which the wording of that kind cannot be in it."""
    for w in fixed.WORDS_OF[kind]:
        if w in low:
            return True
    return False


def is_value(c: str) -> bool:
    return VALUE.match(clean(c)) is not None


def is_year(c: str) -> bool:
    return YEAR.match(clean(c)) is not None


def is_percent(c: str) -> bool:
    return mentions(c.lower(), "PERCENT") and PERCENT.search(c) is not None


def scale_letter(word: str) -> str | None:
    low = word.lower()
    return next((letter for w, letter in fixed.SCALE_LETTERS.items() if low.startswith(w)), None)


def scale_in(text: str) -> str | None:
    """Scale declared by the wording, None if there is none."""
    t = plain(text)
    if "000" in t and ZERO_THOUSANDS.search(t):
        return "K"
    if mentions(t.lower(), "SCALE_WORDS"):
        for p in SCALES:
            if m := p.search(t):
                return scale_letter(m[1])
    return None


def share_scale_in(text: str) -> str | None:
    """Scale of the last wording about shares."""
    t = plain(text)
    low = t.lower()
    if "share" not in low or not mentions(low, "SCALE_WORDS"):
        return None
    last = [found[-1] for p in SHARE_SCALES if (found := p.all(t))]
    # of two that start in the same place the first pattern's
    return scale_letter(max(last, key=lambda m: m.start())[1]) if last else None


def exceptions_in(text: str) -> list[str]:
    """Names of the measures an 'except' clause takes out."""
    t = plain(text)
    if "except" not in t.lower():
        return []
    clause = " ".join(t[m.start(1) : m.end(1)] for m in EXCEPT.all(t))
    return [n for n, p in EXCEPTIONS.items() if p.search(clause)]


def accounting_negative(c: str) -> str:
    """'(5)' -> '-5', '$ (5)' -> '-$5', '(12) %' -> '-12 %'; anything else unchanged."""
    v = clean(c)
    if "(" not in v:
        return v
    if m := ACCOUNTING_PERCENT.match(v):
        return f"-{m[1]} {m[2]}"
    if m := ACCOUNTING_NUMBER.match(v):
        return f"-{m[1] or m[2] or ''}{m[3]}"
    return v


def has_symbol(c: str) -> bool:
    return "$" in c or "€" in c or "£" in c


def scaled(value: re.Match, scale: str, money: bool) -> str:
    """A value with its scale letter; an existing letter is replaced, a footnote stays, money gains a dollar sign."""
    head, number, _, note = value.groups()
    if head or money:
        prefix = "".join(head.split())
        sign = prefix[:1] if prefix[:1] in ("-", "+") else ""
        if symbol := prefix[len(sign) :]:
            head = f"{sign}{symbol} "
        elif money:
            head = f"{sign}$ "
    return f"{head}{number}{scale}{note or ''}"


# ---- formatting tokens in their own cells ---------------------------------------------------------------------------


def is_token(c: str) -> bool:
    return c in TOKENS or (c.startswith(")") and CLOSING.match(c) is not None)


def _negated(v: str) -> str:
    if m := ACCOUNTING_PERCENT.match(v):
        return f"-{m[1]} {m[2]}"
    if m := ACCOUNTING_NUMBER.match(v) or ACCOUNTING_OPEN.match(v):
        return f"-{m[1] or m[2] or ''}{m[3]}"
    return ACCOUNTING_TRAILING.sub(r"-\1\2", v)


def _signed(text: str, token: str) -> str:
    """A value with one more sign."""
    if token == "$":
        if text in DASHES or SIGNED_SYMBOL.match(text):
            return text
        m = MINUS.match(text)
        return f"{m[1]}${text[m.end():]}"
    closing = CLOSING.match(token)
    if closing or token == "(":
        new = _negated(text)
        if new != text:
            return f"{new} %" if closing and closing[1] else new
        return f"-{text}" if token == "(" and FRAGMENT.match(text.replace(" ", "")) else text
    if token == "%":
        return text if ENDS_IN_PERCENT.search(text) else f"{text} %"
    return text


def merged_row(row: list[str]) -> tuple[list[str], int, int]:
    """(cells, negatives, moved) of a row whose formatting signs stand in cells of their own; cells are clean already."""
    if TOKENS.isdisjoint(row) and not any([is_token(c) for c in row if c.startswith(")")]):
        return row, 0, 0
    cells = [(i, c, is_token(c)) for i, c in enumerate(row) if c]
    values = [(i, c) for i, c, token in cells if not token]
    commas = [i for i, c, _ in cells if c == ","]
    heads = [at for k, (at, c) in enumerate(values) if not (k and any(values[k - 1][0] <= i <= at for i in commas) and FRAGMENT.match(c.replace(" ", "")))]
    out, negatives, moved, own = [""] * len(row), 0, 0, 0
    for k, start in enumerate(heads):
        stop, last = heads[k + 1] if k + 1 < len(heads) else len(row), heads[k - 1] if k else -1
        parts = []
        while own < len(values) and values[own][0] < stop:
            parts.append(values[own][1])
            own += 1
        text = ",".join(parts)
        signs = [c for i, c, _ in cells if last < i < start and c in OPENING] + [c for i, c, token in cells if token and start <= i < stop and c not in OPENING]
        for token in signs:
            new = _signed(text, token)
            if new != text:
                negatives += token == "(" or token[0] == ")"
                moved += token == "$"
            text = new
        out[start] = text
    return out, negatives, moved


# ---- tables ----------------------------------------------------------------------------------------------------------


def row_cells(line: str) -> list[str] | None:
    """Cells of a complete pipe row, else None."""
    v = strip(line)
    if not (v.startswith("|") and v.endswith("|")):
        return None
    cells = (_UNESCAPED.split if "\\" in v else _split)(v[1:-1])
    return [c.strip(fixed.ASCII_BLANKS) for c in cells] if v.isascii() else [strip(c) for c in cells]


def _split(inner: str) -> list[str]:
    return inner.split("|")


_UNESCAPED = re.compile(r"(?<!\\)\|")


def spread_units(row: list[str]) -> list[str]:
    """A row that holds only one units declaration is filled with it from the second cell on; cells are clean already."""
    full = [c for c in row if c]
    if not full or not mentions(plain(full[0]).lower(), "SCALE_WORDS"):
        return row
    texts = [plain(c) for c in full]
    if all([UNITS.search(t) for t in texts]) and len({t.lower() for t in texts}) == 1:
        return [full[0] if i and not c else c for i, c in enumerate(row)]
    return row


def first_data_row(rows: list[list[str]]) -> int:
    """Position (from 0) of the first row with a measurement that is no year; the number of rows if there is none. Cells are clean already."""
    for i in range(2, len(rows)):
        for c in rows[i][1:]:
            if VALUE.match(c) and not YEAR.match(c):
                return i
    return len(rows)


def merged_header(target: str, sources: list[str]) -> str:
    """Header texts of removed columns go in front of the kept one; equal texts once."""
    for s in sources:
        if s and s not in TOKENS and s.lower() != target.lower():
            target = f"{s}<br>{target}" if target else s
    return target


def structure_of(rows: list[list[str]], width: int) -> tuple:
    """(rows, removed_columns, negatives, moved): units spread, tokens merged, negatives rewritten, empty columns removed with their headers kept."""
    negatives = moved = 0
    signed = []
    for i, r in enumerate(rows):
        if i != 1:
            r, n, m = merged_row(spread_units([c if c.isascii() else clean(c) for c in r]))
            negatives += n
            moved += m
            turned = [accounting_negative(c) for c in r]
            if turned != r:
                negatives += sum([a != b for a, b in zip(r, turned)])
                r = turned
        signed.append(r)
    start = first_data_row(signed)
    body = signed[start:] if start < len(signed) else signed[2:]
    kept = [0, *[c for c in range(1, width) if any([r[c] for r in body])]]
    head = ["---"] * len(kept)
    if len(kept) == width:
        return [head if i == 1 else r for i, r in enumerate(signed)], 0, negatives, moved
    gone = {k: [] for k in kept}
    for c in range(width):
        if c not in gone:
            # a removed column goes to the next kept one on its right, else to the last kept one
            gone[next((k for k in kept if k > c), kept[-1])].append(c)
    line = lambda r, i: head if i == 1 else [merged_header(r[k], [r[c] for c in gone[k]]) for k in kept] if i < start else [r[k] for k in kept]
    return [line(r, i) for i, r in enumerate(signed)], width - len(kept), negatives, moved


def policy_of(rows: list[list[str]], context: str) -> tuple:
    """(start, default_scale, share_scale, exceptions, currency_default, descriptors) of a table."""
    top, start = rows[0], first_data_row(rows)
    heads = rows[2:start]
    stubs = [r[0] for r in heads if r[0]]
    text = " ".join([context, *top, *stubs])
    declared = [s for s in map(scale_in, [top[0], *stubs]) if s]
    describe = lambda c: " ".join(dict.fromkeys([v for v in [plain(r[c]) for r in [top, *heads]] if v]))
    dollars = (has_symbol(text) or "dollar" in text.lower()) and DOLLARS.search(text) is not None
    return start, declared[-1] if declared else scale_in(context), share_scale_in(text), exceptions_in(text), dollars, [describe(c) for c in range(len(top))]


def columns_of(rows: list[list[str]], policy: tuple) -> list[tuple]:
    """What all cells of a column share: (text, plain_text, scale, change, currency)."""
    data, found = rows[policy[0] :], []
    for c, text in enumerate(policy[5]):
        t = plain(text)
        low = t.lower()
        found.append((text, UNITS_EXCEPTION.without(t) if "except" in low else t, scale_in(text), mentions(low, "CHANGE_COLUMN") and CHANGE.search(t) is not None,
                      c >= 1 and any([has_symbol(r[c]) and CURRENCY.match(clean(r[c])) is not None for r in data])))
    return found


#: A bit for each word without which no wording of its kind is in a text.
_HINTS = [(w, 1 << i) for i, w in enumerate(sorted({w for ws in fixed.WORDS_OF.values() for w in ws}))]
_BITS = {kind: sum(bit for w, bit in _HINTS if w in words) for kind, words in fixed.WORDS_OF.items()}
_COUNT, _PER_SHARE, _PERCENT, _TIME = (_BITS[k] for k in ("SHARE_COUNT", "PER_SHARE", "PERCENT", "TIME_METRIC"))
_ANY = _COUNT | _PER_SHARE | _PERCENT | _TIME


def hints(text: str) -> int:
    low, found = text.lower(), 0
    for w, bit in _HINTS:
        if w in low:
            found |= bit
    return found


def _is_exception(semantic: str, hint: int, exceptions: list[str]) -> bool:
    """Whether a wording names a measure that has no scale; hint: hints of its parts."""
    t = plain(semantic)
    return bool(
        (hint & _PER_SHARE and PER_SHARE.search(t)) or (hint & _PERCENT and PERCENT.search(t)) or (hint & _TIME and TIME_METRIC.search(t))
        or ("ratio" in exceptions and (RATIO.search(t) or RELATION.search(t))) or ("ranking" in exceptions and RANKING.search(t)) or ("employee" in exceptions and EMPLOYEE.search(t)))


def _chosen_scale(row: str, row_scale: str | None, column: tuple, policy: tuple, hint: int, currency: bool) -> str | None:
    """Scale letter of a usable value from its row's wording and scale, what its column shares, and the table's policy; None leaves it alone."""
    _, default, share_scale, exceptions, currency_default, _ = policy
    own = row_scale or column[2]
    if not exceptions and not hint & _ANY:
        return own or default
    semantic = f"{row} {column[1]}"
    shares = bool(hint & _COUNT) and SHARE_COUNT.search(semantic) is not None
    if _is_exception(PER_SHARE.without(semantic) if shares and hint & _PER_SHARE else semantic, hint, exceptions):
        return None
    if own:
        return own
    if shares and not currency and share_scale:
        return share_scale
    if not shares and hint & _PER_SHARE and PER_SHARE.search(semantic):
        return None
    if currency and default:
        return default
    if shares and share_scale:
        return share_scale
    return None if shares and currency_default else default


def table_of(rows: list[list[str]], policy: tuple, columns: list[tuple]) -> list[tuple]:
    """Rows as (cells, label, opens, section), cells as (value, scale, new_value); the section is the last label above that opened one."""
    start, currency_default, section, found = policy[0], policy[4], "", []
    column_hints = [(hints(c[0]), hints(c[1]) if c[1] != c[0] else None) for c in columns]
    for i, r in enumerate(rows):
        label, cells, opens = plain(r[0]), [(c, None, c) for c in r], False
        if i >= 2:
            values = [VALUE.match(c if c.isascii() else clean(c)) for c in r[1:]]
            opens = label != "" and not any(values) and not any([DIGIT.search(c) and is_percent(c) for c in r[1:]])
            if i >= start and not opens:
                text = f"{section} {label}" if section and label else section or label
                row_hint = row_scale = row_money = None
                for j, m in enumerate(values, 1):
                    column, c = columns[j], r[j]
                    if m is None or column[3] or YEAR.match(m.string) or is_percent(c):
                        continue
                    if row_hint is None:  # of the rows that have values
                        row_scale, row_hint = scale_in(text), hints(text)
                    whole, worded = column_hints[j]
                    scale = _chosen_scale(text, row_scale, column, policy, row_hint | (whole if worded is None else worded), has_symbol(m[1]))
                    if scale:
                        money = currency_default or column[4]
                        if not money:  # a word of money is in the row's wording or in the column's
                            row_money = MONETARY.search(text) is not None if row_money is None else row_money
                            money = row_money or MONETARY.search(column[0]) is not None
                        if money and (row_hint | whole) & _COUNT:
                            money = SHARE_COUNT.search(f"{text} {column[0]}") is None
                        cells[j] = (c, scale, scaled(m, scale, money))
        found.append((cells, label, opens, section))
        if opens:
            section = label
    return found


# ---- steps: segments of a document -> the same segments with more fields ---------------------------------------------


def segments(body: str | None) -> list[tuple] | None:
    """(is_table, first_line, lines): alternating text and table segments; a final line break opens no line."""
    if body is None:
        return None
    found, before, lines = [], None, []
    for i, line in enumerate(body.splitlines() or [""]):
        first = line[:1]
        is_table = first == "|" or (first != "" and first in BLANKS and line.lstrip(BLANKS).startswith("|"))
        if is_table is not before:
            before, lines = is_table, []
            found.append((is_table, i, lines))
        lines.append(line)
    return found


def context_of(above: list[str]) -> str:
    """Last text block above a table: trailing blanks skipped, then up to eight lines back to a blank line or '---'."""
    block: list[str] = []
    for line in map(strip, reversed(above)):
        if line == "---" or (not line and block):
            break
        if line:
            block.append(line)
        if len(block) == fixed.CONTEXT_LINES:
            break
    return " ".join(reversed(block))


def with_context(segs: list[tuple] | None) -> list[tuple] | None:
    """Adds context."""
    return segs and [(*s[:3], (context_of(segs[k - 1][2]) if k else "") if s[0] else None) for k, s in enumerate(segs)]


def _judged(lines: list[str]) -> tuple:
    rows = [row_cells(line) for line in lines]
    if None in rows:
        return None, None, "not a complete pipe table row"
    width = len(rows[0])
    if any(len(r) != width for r in rows):
        return None, None, "inconsistent source row widths"
    if width < 2 or len(rows) < 3:
        return None, None, "not a complete Markdown table"
    if not all(all(DELIMITER.match(clean(c)) for c in r) == (i == 1) for i, r in enumerate(rows)):
        return None, None, "missing or nonstandard delimiter row"
    return rows, width, None


def parsed(segs: list[tuple] | None) -> list[tuple] | None:
    """Adds rows, width and reason."""
    return segs and [(*s[:4], *(_judged(s[2]) if s[0] else (None, None, None))) for s in segs]


def repaired(segs: list[tuple] | None) -> list[tuple] | None:
    """Adds removed_columns, negatives and moved behind the repaired rows, which follow the reason."""
    return segs and [(*s[:4], s[6], *(structure_of(s[4], s[5]) if s[4] is not None else (None,) * 4)) for s in segs]


def with_policy(segs: list[tuple] | None) -> list[tuple] | None:
    """Adds policy."""
    return segs and [(*s[:9], policy_of(s[5], s[3]) if s[5] is not None else None) for s in segs]


def scaled_tables(segs: list[tuple] | None) -> list[tuple] | None:
    """Adds columns and table."""
    def both(rows, policy):
        columns = columns_of(rows, policy)
        return columns, table_of(rows, policy, columns)
    return segs and [(*s[:10], *(both(s[5], s[9]) if s[5] is not None else (None, None))) for s in segs]


# ---- results of the steps: a list for each field ----------------------------------------------------------------------


def rows_of(segs: list[tuple] | None) -> tuple:
    """(seg_no, row_no, value, scale, new_value, label, opens, section, at, columns) of all tables: columns[at] are those of the row's table."""
    found = tuple([] for _ in range(10))
    seg_no, row_no, value, scale, new_value, label, opens, section, at, columns = found
    for k, s in enumerate(segs or [], 1):
        if s[11] is not None:
            for i, (cells, *about) in enumerate(s[11]):
                for own, x in zip((seg_no, row_no, label, opens, section, at), (k, i, *about, len(columns))):
                    own.append(x)
                for own, x in zip((value, scale, new_value), zip(*cells)):
                    own.append([*x])
            columns.append(s[10])
    return found


def cells_of(segs: list[tuple] | None) -> tuple:
    """(seg_no, row_no, col_no, value, scale, new_value, currency_column) of all tables."""
    seg_no, row_no, col_no, cells, currency = [], [], [], [], []
    for k, s in enumerate(segs or [], 1):
        if s[11] is not None:
            width, signs = len(s[10]), [c[4] for c in s[10]]
            for i, r in enumerate(s[11]):
                seg_no += [k] * width
                row_no += [i] * width
                col_no += range(width)
                cells += r[0]
                currency += signs
    value, scale, new_value = map(list, zip(*cells)) if cells else ([], [], [])
    return seg_no, row_no, col_no, value, scale, new_value, currency


def rewritten(segs: list[tuple] | None) -> list[tuple] | None:
    """(is_table, first_line, lines, reason, removed_columns, negatives, moved, new_lines, changed, added_k, added_m, added_b, added_t)."""
    def one(s):
        if s[11] is None:
            return (*s[:3], s[4], *s[6:9], s[2], False, None, None, None, None)
        lines = [f"| {' | '.join([strip(c[2]) for c in r[0]])} |" for r in s[11]]
        added = [scale for r in s[11] for value, scale, new_value in r[0] if scale is not None and new_value != value]
        return (*s[:3], s[4], *s[6:9], lines, lines != s[2], added.count("K"), added.count("M"), added.count("B"), added.count("T"))
    return segs and [one(s) for s in segs]


def summed_up(segs: list[tuple] | None) -> tuple | None:
    """(text, changed_tables, skipped_tables, removed_columns, negatives, moved, added_k, added_m, added_b, added_t, skip_reasons) of rewritten segments."""
    if segs is None:
        return None
    changed = [s for s in segs if s[0] and s[8]]
    left = [s[3] for s in segs if s[0] and not s[8] and s[3] is not None]
    total = lambda at: sum([s[at] or 0 for s in changed])
    return ("\n".join([line for s in segs for line in s[7]]), len(changed), len(left), total(4), total(5), total(6), total(9), total(10), total(11), total(12), "; ".join(sorted(set(left))))


def labelled_rows(text: str | None, labels: list[str]) -> tuple:
    """(line_no, label, cells behind it) of the pipe rows of a text that begin with one of the labels."""
    rows = [(n, row_cells(line)) for n, line in enumerate([] if text is None else text.split("\n")) if "|" in line]
    rows = [(n, r) for n, r in rows if r is not None and r[0] in labels]
    return [n for n, _ in rows], [r[0] for _, r in rows], [r[1:] for _, r in rows]
