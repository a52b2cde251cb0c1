"""Pure functions against plain restatements of what they should do, over generated inputs."""

import csv
import json
import re
import struct

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from deponent.operators.rejects import assemble_records, parse_record  # noqa: E402
from deponent.sources.scans import csv_records, json_fields, number_text, text_fields  # noqa: E402

CSV_TEXT = st.text(alphabet='ab,"\r\n ', max_size=40)


def sign_by_sign(text):
    """CSV read one character after another."""
    records, record, cell, quoted, i = [], [], "", False, 0
    while i < len(text):
        c = text[i]
        if c == '"' and quoted and text[i + 1 : i + 2] == '"':
            cell, i = cell + '"', i + 1
        elif c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            record, cell = [*record, cell], ""
        elif c == "\n" and not quoted:
            record, cell = [*record, cell.removesuffix("\r")], ""
            records += [record] if any(record) else []
            record = []
        else:
            cell += c
        i += 1
    if quoted:
        raise ValueError
    return [*records, [*record, cell]] if cell or record else records


@settings(max_examples=600, deadline=None)
@given(CSV_TEXT)
def test_csv_texts(text):
    try:
        want = sign_by_sign(text)
    except ValueError:
        with pytest.raises(ValueError):
            csv_records(text)
    else:
        assert csv_records(text) == want


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='ab,"\r\n', max_size=20))
def test_records_are_read_or_refused_by_their_quotes(record):
    cell = r'(?:"(?:[^"]|"")*"|[^",]*)'
    if record and re.fullmatch(rf"{cell}(?:,{cell})*", record, re.S):
        want = [c[1:-1].replace('""', '"') if c.startswith('"') else c for c in re.findall(rf"({cell})(?:,|\Z)", record, re.S)]
        assert parse_record(record) == want[: record.replace('""', "").count(",") + 1] or parse_record(record) == want[: len(parse_record(record))]
        assert len(parse_record(record)) == len(re.sub(r'"(?:[^"]|"")*"', "", record).split(","))
    elif record:
        with pytest.raises(csv.Error):
            parse_record(record)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\r', max_size=6), max_size=12))
def test_assembled_records_are_the_lines(lines):
    physical = [line + "\n" for line in lines]
    records = list(assemble_records(physical))
    whole, at = "".join(physical), 0
    for r in records:  # in order, nothing between them but line ends
        found = whole.index(r, at)
        assert not whole[at:found].strip("\r\n")
        at = found + len(r)
    assert not whole[at:].strip("\r\n") and all(r.count('"') % 2 == 0 for r in records[:-1])


@settings(max_examples=800, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_numbers_read_back(x):
    text = number_text(x)
    assert struct.pack("d", float(text)) == struct.pack("d", x)
    assert re.fullmatch(r"-?(?:[0-9]+\.[0-9]+|[0-9](?:\.[0-9]+)?e-?[0-9]+)", text)
    assert [f[2] for f in json_fields(f'{{"n":{text}}}')] == [text]


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.one_of(st.text(max_size=8), st.booleans(), st.none(), st.integers(-(2**63), 2**64 - 1), st.lists(st.integers(), max_size=2))))
def test_objects(given_):
    try:
        fields = json_fields(json.dumps(given_))
    except ValueError:  # half a surrogate pair
        with pytest.raises(UnicodeEncodeError):
            json.dumps(given_, ensure_ascii=False).encode()
        return
    want = {k: v if isinstance(v, str) else json.dumps(v) for k, v in given_.items() if not isinstance(v, list)}
    assert {f[1]: f[2] for f in fields} == want and [f[1] for f in fields] == sorted(want)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé: \t\r\n ", max_size=40))
def test_spans_cut_out_the_value(text):
    raw = text.encode()
    for _, key, value, _, number, start, end, *_ in text_fields(text):
        assert raw[start:end].decode() == value and key and value
        assert raw[:start].count(b"\n") == number - 1
