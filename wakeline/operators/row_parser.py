"""Rows that fail to parse (problem 5): minimum-cost error parse.

A line is parsed by a quoting grammar whose edits cost: a quote that must be put in or taken out, and a delimiter
that must be put in or taken out to reach the expected field count. The cheapest parse (quote edits weigh more than
any delimiter edits) is found by dynamic programming over the line's positions. A parse without edits whose fields
have valid types loads; otherwise the edits state the reason: a quote edit means ``broken_quote``, a delimiter edit
``column_count``; then the typed checks ``missing_ts``, ``missing_core`` and ``bad_coords`` in this order.

Every line that needs an edit goes through the dynamic programming. Lines that need none have one parse, which cheaper
means find: without a quote it is the split by the delimiter in the JVM, with quotes a match of the grammar without
edits. Defined results: a null line counts as empty (one blank field); a source without a known delimiter is read with
a comma; blanks around a field don't matter; bad SOG or COG load as null; very long lines are parsed whole, in time
proportional to their length.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import bounded_local

FIELDS = 8
#: Field order of the source files and the text forms.
NAMES = ["mmsi", "ts", "mobile_type", "lat", "lon", "sog", "cog", "ship_type"]
RX_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RX_DMY = r"^([0-9]{2})/([0-9]{2})/([0-9]{4}) ([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"
RX_ISO = r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[Tt ]([01][0-9]|2[0-3]):?[0-5][0-9](:?[0-5][0-9]([.,][0-9]+)?)?([Zz]|[+-]([01][0-9]):?([0-5][0-9])?)?$"
BLANK = " \t\r\n\u000b\u000c "

#: Marks in a parse: a field opens with a quote, ends plain, ends after a quote.
OPEN, CUT_PLAIN, CUT_QUOTED = 0, 1, 2

_grammars: dict[str, re.Pattern] = {}  # a decorated function could not be pickled by value


def _grammar(delimiter: str) -> re.Pattern:
    if delimiter in _grammars:
        return _grammars[delimiter]
    d, blank = re.escape(delimiter), "[" + re.escape(BLANK.replace(delimiter, "")) + "]"
    _grammars[delimiter] = re.compile(rf'(?:{blank}*+"((?:[^"]|"")*+)"{blank}*+|({blank}*+(?!")[^{d}]*+))({d}|\Z)')
    return _grammars[delimiter]


def exact_parse(line: str, delimiter: str) -> list[str] | None:
    """The fields of a line that the grammar reads without quote edits; None if it doesn't."""
    rx, blanks, out, at = _grammar(delimiter), BLANK.replace(delimiter, ""), [], 0
    while m := rx.match(line, at):
        out.append(m[2].strip(blanks) if m[1] is None else m[1].replace('""', '"'))
        if not m[3]:
            return out
        at = m.end()
    return None


def min_cost_parse(line: str, delimiter: str, fields: int = FIELDS) -> tuple[int, int, list[str]]:
    """(quote edits, delimiter edits, fields) of the cheapest parse; quote edits weigh more than any delimiter edits.

    Modes: start of a field (S), plain field (P), inside quotes (Q), after a closing quote (A), after blanks behind it
    (B). A state is a mode and the number of fields finished. Reading a character moves between states at no cost
    where the grammar allows it. Edits: a quote is put in before a delimiter or at the end, or taken out; at the end
    of the line delimiters are taken out or put in until the fields are as many as asked for, at one edit each
    wherever it is done. Of states of one mode that cost more quote edits none can win, nor of those that have all
    fields asked for can any but the one with fewest, so there are at most 5 * (fields + 1). Each state keeps a link
    to the one before; the fields are put together from the cheapest chain at the end.
    """
    blanks = BLANK.replace(delimiter, "")
    # mode -> (quote edits, {finished fields, or -1 for all asked for: (finished fields, link)}); a link is (link before, mark)
    states: dict[str, tuple[int, dict[int, tuple[int, tuple | None]]]] = {"S": (0, {0: (0, None)})}

    def offer(into: dict, mode: str, quotes: int, done: int, link) -> None:
        old = into.get(mode)
        if old is None or quotes < old[0]:
            old = into[mode] = (quotes, {})
        if quotes == old[0]:
            key = done if done < fields else -1
            if key not in old[1] or done < old[1][key][0]:
                old[1][key] = (done, link)

    for ch in line:
        nxt: dict[str, tuple[int, dict[int, tuple[int, tuple | None]]]] = {}
        for mode, (q, known) in states.items():
            for done, link in known.values():
                if ch == delimiter and mode != "Q":
                    offer(nxt, "S", q, done + 1, (link, CUT_PLAIN if mode in "SP" else CUT_QUOTED))
                elif mode in "SP":
                    if mode == "S" and ch == '"':
                        offer(nxt, "Q", q, done, (link, OPEN))
                        offer(nxt, "P", q + 1, done, link)  # the opening quote is taken out
                    else:
                        offer(nxt, "S" if mode == "S" and ch in blanks else "P", q, done, (link, ch))
                elif mode == "Q":
                    if ch == '"':
                        offer(nxt, "A", q, done, link)
                        offer(nxt, "Q", q + 1, done, link)  # a stray quote is taken out
                    else:
                        offer(nxt, "Q", q, done, (link, ch))
                        if ch == delimiter:  # a closing quote is put in before the delimiter
                            offer(nxt, "S", q + 1, done + 1, (link, CUT_QUOTED))
                elif ch in blanks:
                    offer(nxt, "B", q, done, link)
                elif mode == "A" and ch == '"':
                    offer(nxt, "Q", q, done, (link, ch))  # a doubled quote
                else:
                    offer(nxt, "Q", q + 1, done, (link, ch))  # the closing quote is taken out
        states = nxt
    ends = [(q + (mode == "Q"), abs(done + 1 - fields), mode, link) for mode, (q, known) in states.items() for done, link in known.values()]
    best = min(ends, key=lambda x: x[:3])
    marks, link = [], best[3]
    while link is not None:
        link, mark = link
        marks.append(mark)
    parsed: list[str] = []
    cur: list[str] = []
    for mark in [*reversed(marks), CUT_PLAIN if best[2] in "SP" else CUT_QUOTED]:
        if mark == OPEN:
            cur = []
        elif mark in (CUT_PLAIN, CUT_QUOTED):
            text = "".join(cur)
            parsed.append(text.strip(blanks) if mark == CUT_PLAIN else text)
            cur = []
        else:
            cur.append(mark)
    return best[0], best[1], parsed


def _parse(line: str | None, delimiter: str) -> tuple[int, int, list[str] | None]:
    if line is None:
        return 0, 0, None
    fields = exact_parse(line, delimiter)
    return (0, 0, fields) if fields is not None and len(fields) == FIELDS else min_cost_parse(line, delimiter)


def _parse_lines(lines: pd.Series, delimiters: pd.Series) -> pd.DataFrame:
    rows = [_parse(x, d) for x, d in zip(lines, delimiters)]
    edits = {n: pd.array([r[k] for r in rows], dtype="int32") for k, n in enumerate(("quote_edits", "delimiter_edits"))}
    return pd.DataFrame(edits | {"fields": pd.Series([r[2] for r in rows], dtype=object)})


def _real_date(y: Column, m: Column, d: Column) -> Column:
    return F.coalesce(F.concat_ws("-", y, m, d).try_cast("date").isNotNull() & (y != "0000"), F.lit(False))


def _valid_ts(t: Column) -> Column:
    digits = F.regexp_replace(F.substring(t, 1, 10), "-", "")
    iso = t.rlike(RX_ISO) & _real_date(F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2))
    dmy = t.rlike(RX_DMY) & _real_date(F.substring(t, 7, 4), F.substring(t, 4, 2), F.substring(t, 1, 2))
    return dmy | iso


def parse_lines(lines: DataFrame, progress: DataFrame, *, max_sources: int = 100_000) -> DataFrame:
    """All columns of lines plus typed fields, quote_edits, delimiter_edits and reason (null where the line loads)."""
    latest = progress.filter(F.col("delimiter").isNotNull()).groupBy(F.col("source_path").alias("__src")).agg(F.max_by("delimiter", F.struct("updated_at", "rows_read", "delimiter")).alias("__delim"))
    params, small = bounded_local(latest, max_sources)
    joined = lines.join(F.broadcast(params) if small else params, F.col("source_path") == F.col("__src"), "left").drop("__src")
    text, delim = F.coalesce(F.col("line"), F.lit("")), F.coalesce(F.col("__delim"), F.lit(","))
    plain = F.split(text, F.concat(F.lit("\\Q"), delim, F.lit("\\E")), -1)
    clean = (F.instr(text, '"') == 0) & (F.size(plain) == FIELDS)
    udf = F.pandas_udf(_parse_lines, "struct<quote_edits int, delimiter_edits int, fields array<string>>")
    parsed = joined.withColumn("__q", udf(F.when(~clean, text), delim))
    f = F.transform(F.when(clean, plain).otherwise(F.col("__q.fields")), lambda x: F.btrim(x, F.lit(BLANK)))
    # A generator of one row keeps the optimizer from splitting each line anew for every field.
    parsed = parsed.select("*", F.inline(F.array(F.struct(f.alias("__f")))))
    get = {n: F.get(F.col("__f"), F.lit(i)) for i, n in enumerate(NAMES)}
    number = {n: F.when(get[n].rlike(RX_DECIMAL), get[n].try_cast("double")) for n in ("mmsi", "lat", "lon", "sog", "cog")}
    core = get["mmsi"].rlike(RX_DECIMAL) & get["lat"].rlike(RX_DECIMAL) & get["lon"].rlike(RX_DECIMAL)
    reason = (
        F.when(F.col("__q.quote_edits") > 0, "broken_quote")
        .when(F.col("__q.delimiter_edits") > 0, "column_count")
        .when(~F.coalesce(_valid_ts(get["ts"]), F.lit(False)), "missing_ts")
        .when(~F.coalesce(core, F.lit(False)), "missing_core")
        .when(~(number["lat"].between(-90, 90) & number["lon"].between(-180, 180)), "bad_coords")
    )
    parsed = parsed.withColumns({"reason": reason, "quote_edits": F.coalesce(F.col("__q.quote_edits"), F.lit(0)), "delimiter_edits": F.coalesce(F.col("__q.delimiter_edits"), F.lit(0))})
    ok = F.col("reason").isNull()
    typed = {f"p_{n}": F.when(ok, number[n] if n in number else F.nullif(get[n], F.lit(""))) for n in NAMES}
    typed["p_mmsi"] = F.when(ok, number["mmsi"].cast("decimal(20,0)").try_cast("bigint"))
    return parsed.withColumns(typed).drop("__q", "__f", "__delim")


def found_bad_lines(lines: DataFrame, progress: DataFrame) -> DataFrame:
    """line_id and reason of each line that can't be loaded."""
    done = parse_lines(lines.select("line_id", "source_path", "line"), progress.select("source_path", "delimiter", "updated_at", "rows_read"))
    return done.filter(F.col("reason").isNotNull()).select("line_id", "reason")


def reject_counts(lines: DataFrame, progress: DataFrame) -> DataFrame:
    """Loaded and rejected lines per source and reason."""
    done = parse_lines(lines.select("line_id", "source_path", "line"), progress.select("source_path", "delimiter", "updated_at", "rows_read"))
    return done.groupBy("source_path", F.coalesce("reason", F.lit("loaded")).alias("reason")).agg(F.count("*").alias("n_lines"))
