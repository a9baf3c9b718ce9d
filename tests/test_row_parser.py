import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wakeline.operators.row_parser import exact_parse, found_bad_lines, min_cost_parse, parse_lines
from wakeline.session import load

DEC = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$", re.A)


def strict_fields(line, d):
    """Brute force: the fields of a line, or None if a quote is broken."""
    out, i = [], 0
    while True:
        j = i
        while j < len(line) and line[j] in " \t" and line[j] != d:
            j += 1
        if j < len(line) and line[j] == '"':
            cur, j = "", j + 1
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"':
                    if line[j + 1 : j + 2] == '"':
                        cur, j = cur + '"', j + 2
                        continue
                    break
                cur, j = cur + line[j], j + 1
            j += 1
            while j < len(line) and line[j] in " \t" and line[j] != d:
                j += 1
            if j < len(line) and line[j] != d:
                return None
            out.append(cur)
        else:
            k = line.find(d, i)
            k = len(line) if k < 0 else k
            out.append(line[i:k].strip(" \t"))
            j = k
        if j >= len(line):
            return out
        i = j + 1


def strict_reason(line, d):
    f = strict_fields(line or "", d)
    if f is None:
        return "broken_quote"
    if len(f) != 8:
        return "column_count"
    f = [x.strip() for x in f]
    ok = False
    if re.fullmatch(r"\d\d/\d\d/\d{4} \d\d:\d\d:\d\d", f[1]):
        try:
            datetime.datetime.strptime(f[1], "%d/%m/%Y %H:%M:%S")
            ok = True
        except ValueError:
            pass
    elif re.match(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d", f[1]):
        try:
            datetime.datetime.fromisoformat(f[1])
            ok = True
        except ValueError:
            pass
    if not ok:
        return "missing_ts"
    if not all(DEC.match(f[i]) for i in (0, 3, 4)):
        return "missing_core"
    if not (-90 <= float(f[3]) <= 90 and -180 <= float(f[4]) <= 180):
        return "bad_coords"
    return None


def test_whole_table_against_brute_force(spark, sf):
    lines, progress = load(spark, sf, "ais_raw_lines"), load(spark, sf, "ais_import_progress")
    delim = {r["source_path"]: r["delimiter"] for r in progress.collect()}
    want = {(r["line_id"], why) for r in lines.collect() if (why := strict_reason(r["line"], delim[r["source_path"]]))}
    assert {tuple(r) for r in found_bad_lines(lines, progress).collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='ab",; ', max_size=25))
def test_quote_edits_exactly_where_the_grammar_breaks(line):
    edits, _, fields = min_cost_parse(line, ",")
    want = strict_fields(line, ",")
    assert (edits > 0) == (want is None)
    if want is not None:
        assert fields == want


def test_nulls_blank_lines_unknown_sources_and_long_lines(spark):
    lines = spark.createDataFrame(
        [(1, "s", None), (2, "s", ""), (3, "nowhere", "1,06/10/2010 17:17:29,A,5,6,bad,,X"), (4, None, "1,06/10/2010 17:17:29,A,95,6,1,2,X"), (5, "s", '"' + "x" * 100_000), (5, "s", "x;" * 50_000)],
        "line_id bigint, source_path string, line string",
    )
    progress = spark.createDataFrame([("s", ";", None, None), ("s", None, None, 1)], "source_path string, delimiter string, updated_at timestamp, rows_read bigint")
    got = sorted((r["line_id"], r["reason"]) for r in found_bad_lines(lines, progress).collect())
    assert got == [(1, "column_count"), (2, "column_count"), (4, "bad_coords"), (5, "broken_quote"), (5, "column_count")]
    loaded = parse_lines(lines, progress).filter("line_id = 3").first()
    assert (loaded["p_mmsi"], loaded["p_lat"], loaded["p_sog"], loaded["p_cog"]) == (1, 5.0, None, None)
    assert found_bad_lines(lines.limit(0), progress.limit(0)).count() == 0


@pytest.mark.parametrize("ts,ok", [("2010-02-30T10:00:00Z", False), ("2010-10-06T13:30Z", True), ("31/04/2010 01:02:03", False), ("20101006T133000Z", True), ("2010-10-06", False)])
def test_timestamp_forms(spark, ts, ok):
    lines = spark.createDataFrame([(1, "s", f"1,{ts},A,5,6,1,2,X")], "line_id bigint, source_path string, line string")
    progress = spark.createDataFrame([], "source_path string, delimiter string, updated_at timestamp, rows_read bigint")
    assert found_bad_lines(lines, progress).count() == (0 if ok else 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",; \t', max_size=25), st.sampled_from([2, 4, 8]))
def test_lines_without_edits_have_one_parse(line, fields):
    """The cheap readings of lines that need no edit are those of the dynamic programming."""
    quotes, delims, parsed = min_cost_parse(line, ",", fields)
    exact = exact_parse(line, ",")
    assert (exact is None) == (quotes > 0)
    if exact is not None:
        assert delims == abs(len(exact) - fields)
        assert parsed == exact
    if '"' not in line:
        assert exact == [x.strip(" \t") for x in line.split(",")] and quotes == 0


def brute_cost(line, fields):
    """Fewest (quote, delimiter) edits by trying every set of quotes taken out or put before a delimiter or the end."""
    import itertools

    best = None
    at = [i for i, c in enumerate(line) if c == '"']
    slots = [i for i, c in enumerate(line) if c == ","] + [len(line)]
    for out in itertools.chain.from_iterable(itertools.combinations(at, k) for k in range(len(at) + 1)):
        for put in itertools.chain.from_iterable(itertools.combinations(slots, k) for k in range(2)):
            text = "".join(('"' if i in put else "") + ("" if i in out else c) for i, c in enumerate(line)) + ('"' if len(line) in put else "")
            f = strict_fields(text, ",")
            if f is not None:
                cost = (len(out) + len(put), abs(len(f) - fields))
                best = cost if best is None else min(best, cost)
    return best


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='a",', max_size=9))
def test_quote_costs_are_least(line):
    """Delimiter edits aren't compared: the brute force may also open a field with a new quote, which is no edit of the parser's."""
    got = min_cost_parse(line, ",", 3)[:2]
    assert got[0] <= brute_cost(line, 3)[0]


def test_a_long_line_takes_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        min_cost_parse('"' + "x" * n, ";")
        return time.perf_counter() - began

    took(1000)
    assert took(200_000) < 12 * took(50_000) + 0.2
