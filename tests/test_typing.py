"""Coercion, inference, names, guard and charsets, checked against the rules written out in plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabmend.functions import charset
from tabmend.functions.typed import BOOL, FLOAT, INT, TEXT, coerce, fits
from tabmend.operators.guard import guard, kept
from tabmend.operators.infer import describe_types, infer_carrier_types, mismatch_counts
from tabmend.operators.names import output_names, quoted, unique_names
from tabmend.options import ConversionError, Options, parse_delimiter

PLAIN = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")


def as_int(text):
    """The rule: canonical digits within 64 bits."""
    if re.fullmatch(r"0|-?[1-9][0-9]*", text) and -(2**63) <= int(text) < 2**63:
        return int(text)


def as_float(text):
    """The rule: a plain number that a double gives back: whole ones up to 2^53, else 15 significant digits in the normal range."""
    if not PLAIN.fullmatch(text) or text == "-0":
        return None
    mantissa = re.split("[eE]", text)[0].lstrip("-")
    if re.fullmatch(r"-?[0-9]+", text):
        return float(text) if abs(int(text)) <= 2**53 else None
    digits = mantissa.replace(".", "").lstrip("0")
    digits = digits.rstrip("0") if "." in mantissa else digits
    value = float(text)
    if not digits.strip("0"):
        return value
    return value if len(digits) <= 15 and 2.0**-1022 <= abs(value) < float("inf") else None


def as_bool(text):
    return {"true": True, "false": False}.get(text.lower())


def kind_of(column):
    """The first of int, float and bool that all filled cells fit."""
    filled = [c for c in column if c]
    for kind, rule in ((INT, as_int), (FLOAT, as_float), (BOOL, as_bool)):
        if filled and all(rule(c) is not None for c in filled):
            return kind
    return TEXT


def values(spark, cells, kind):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(coerce(F.col("c"), kind)).collect()]


WHOLE = [str(sign * (2**k + d)) for k in (0, 7, 31, 52, 53, 62, 63, 64) for d in (-1, 0, 1) for sign in (1, -1)]
SPOILED = [form.format(x) for x in ("5", "80", "1234") for form in ("0{}", "+{}", " {}", "{} ", "{}\t", "{}_0", "{}.", ".{}", "{}e", "{}e+", "e{}", "--{}", "{}-", "{},{}".replace("{},{}", "{},1"), "{}f", "0b{}")]
SCALED = [f"{m}{e}" for m in ("3.75", "-0.125", "90", "1.000", "7.123456789012", "7.12345678901234", "7.123456789012345", "0.00012345678901234500") for e in ("", "e0", "E5", "e-7", "e+12", "e-305", "e-310", "e307", "e400")]
ODD = ["", "-", "nan", "NaN", "Infinity", "-inf", "null", "x", "１２", "৪"]


def test_coercion_follows_the_rules(spark):
    cells = WHOLE + SPOILED + SCALED + ODD
    assert values(spark, cells, INT) == [as_int(c) for c in cells]
    assert values(spark, cells, FLOAT) == [as_float(c) for c in cells]
    assert values(spark, [*cells, None], TEXT) == [*cells, ""]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.integers(-(2**66), 2**66).map(str), st.floats().map(repr), st.from_regex(r"-?[0-9]{1,20}(\.[0-9]{1,20})?([eE][+-]?[0-9]{1,3})?", fullmatch=True), st.text("0123456789.eE+-", max_size=8)), min_size=1, max_size=60))
def test_coercion_of_drawn_texts(spark, cells):
    assert values(spark, cells, INT) == [as_int(c) for c in cells]
    assert values(spark, cells, FLOAT) == [as_float(c) for c in cells]


def test_bools_in_any_case(spark):
    cells = ["".join(x.upper() if i >> j & 1 else x for j, x in enumerate(word)) for word in ("true", "false") for i in range(0, 32, 3)]
    cells += ["t", "f", "0", "on", "truee", " true", ""]
    assert values(spark, cells, BOOL) == [as_bool(c) for c in cells]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["", "8", "-31", "6.5", "2e3", "TRUE", "false", "north", "08", str(2**63)]), min_size=1, max_size=4), max_size=5))
def test_inference_takes_the_narrowest_kind(spark, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "pos long, cells array<string>")
    columns = [[r[i] for r in rows if i < len(r)] for i in range(4)]
    kinds = infer_carrier_types(df, 4)
    assert kinds == [kind_of(c) for c in columns]
    for i, kind in enumerate(kinds):
        assert df.filter(~fits(F.coalesce(F.get("cells", F.lit(i)), F.lit("")), kind)).isEmpty()


@pytest.mark.parametrize("rows", [3, 40, 10**9])
def test_inference_sees_the_first_rows_only(spark, monkeypatch, rows):
    monkeypatch.setattr("tabmend.operators.carrier.TOP_ROWS", 20)
    cells = [["4"] if i < 40 else ["4.5"] if i < 60 else ["late"] for i in range(80)]
    df = spark.createDataFrame([(i // 30, i, c) for i, c in enumerate(cells)], "part long, pos long, cells array<string>").repartition(5)
    assert infer_carrier_types(df, 1, rows) == [kind_of([c for c, in cells[:rows]])]


def test_misfits_are_counted(spark):
    cells = ["12", "twelve", "", None, "1.2"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert mismatch_counts(df, [F.col("c"), F.col("c"), F.col("c")], [INT, FLOAT, TEXT]) == [2, 1, 0]
    assert describe_types([FLOAT, TEXT, FLOAT]) == "0 int, 2 float, 0 bool, 1 text"


NAMES = st.lists(st.sampled_from(["", "  ", "k", "K", "k_1", "c0", "c2", "total", "Total_1", "c1_1"]), max_size=8)


@given(NAMES, st.booleans())
def test_names_become_unique_and_first_ones_stay(given_names, fold):
    got = unique_names(given_names, fold_case=fold)
    keys = [n.lower() if fold else n for n in got]
    assert len(got) == len(given_names) and len(set(keys)) == len(keys) and all(n.strip() for n in got)
    for i, (name, new) in enumerate(zip(given_names, got, strict=True)):
        name = name.strip() or f"c{i}"
        assert new == name or re.fullmatch(re.escape(name) + r"_[1-9][0-9]*", new)
        if name not in [x for x in got[:i]] and not (fold and name.lower() in keys[:i]):
            assert new == name


def test_given_names_and_quotes():
    assert output_names(["p", "q", "r"], "one,two , three") == ["one", "two", "three"]
    for bad in ("one,two", "one,,three", "one,two,three,four"):
        with pytest.raises(ConversionError):
            output_names(["p", "q", "r"], bad)
    assert quoted('tall"er') == '"tall""er"'


def test_delimiters():
    assert [parse_delimiter(x) for x in ("\\n", "r", ":", ";;;", "")] == ["\n", "\r", ":", ";", ","]
    with pytest.raises(ConversionError):
        parse_delimiter("é")


def guarded(spark, rows, width, **options):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "pos long, cells array<string>")
    return guard(df, width, Options(**options))


def test_guard_trims_then_cuts_and_counts_widths(spark):
    out = guarded(spark, [["**north**", "*"], ["one"], ["a", "b", "c", "d"], []], 3, max_field=4, trim="*")
    assert [r["cells"] for r in kept(out).orderBy("pos").collect()] == [["nort", "", ""], ["one", "", ""], ["a", "b", "c"], ["", "", ""]]
    assert out.agg(F.sum("n_bad")).first()[0] == 4


@pytest.mark.parametrize("width", [3, 300])
def test_runaway_rows_go(spark, width):
    most = max(16 * width, 4096)
    out = guarded(spark, [["y"] * (most + d) for d in (-1, 0, 1)], width)
    assert [r["cells"] for r in kept(out).collect()] == [["y"] * width] * 2


def test_strict_width_names_the_first_bad_row(spark):
    rows = [["a", "b", "c"]] * 4 + [["a"], ["a", "b"]]
    with pytest.raises(ConversionError, match="row 5: got 1 fields, expected 3"):
        guarded(spark, rows, 3, strict=True)


@pytest.mark.parametrize("label", ["windows-1252", "windows-1251", "iso-8859-2"])
def test_mojibake_is_undone_and_other_text_stays(spark, label):
    upper = charset.upper_half(charset.single_byte(label))
    wrong = lambda text: "".join(upper[b - 128] if b > 127 else chr(b) for b in text.encode())
    texts = ["Überraschung", "señal de año", "only ascii", "Ж", "šílený kůň"]
    df = spark.createDataFrame([(i, wrong(t), t) for i, t in enumerate(texts)], "i int, w string, t string").orderBy("i")
    got = df.select(charset.unmojibake(F.col("w"), label), charset.unmojibake(F.col("t"), label)).collect()
    assert [tuple(r) for r in got] == [(t, t) for t in texts]


def test_labels():
    assert charset.single_byte("ISO-8859-1") == "windows-1252"
    assert charset.upper_half("windows-1252")[0] == "€" and len(set(charset.upper_half("windows-1251"))) == 128
    for bad in ("utf-16le", "euc-kr", "klingon"):
        with pytest.raises(ConversionError):
            charset.single_byte(bad)


def test_detection():
    assert charset.detect_encoding("﻿kopf;zeile\n".encode()) == "utf-8"
    assert charset.detect_encoding("kopf;zeile\n".encode("utf-16")) == "utf-16le"
    assert charset.detect_encoding("В чащах юга жил был цитрус, да но фальшивый экземпляр".encode("cp1251")) == "windows-1251"
    assert charset.detect_encoding("Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich".encode("cp1252")) == "windows-1252"
    assert charset.detect_encoding("あさひがのぼると、とりがなきはじめました。".encode("cp932")) == "shift_jis"


def test_fallback_query_decodes_every_language(spark, tmp_path):
    rows = [(1, "größer als", "de"), (2, "mañana", "es"), (3, "it’s plain", "en"), (4, "naïve", None), (5, "déjà", "fr"), (6, "日本 größer", None), (7, None, "de"), (8, "", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    from tabmend.queries import QUERIES

    out = QUERIES["fallback_decode"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [r[:2] for r in rows]


def test_plain_floats_skip_the_digit_rules(spark):
    """Short decimals are read by one short branch, and by the same rule as long ones."""
    from pyspark.sql import functions as F

    from tabmend.functions import typed

    cells = ["0", "-0", "-0.0", "0.0000000000001", "123456789012345", "1234567890123456", "-12345678901.50", "00.5", ".5", "1.", "1e3", "", None, "999999999999999.9"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [r[0] for r in df.select(typed.parse_float(F.col("c"))).collect()]
    assert [None if v is None else repr(v) for v in got] == ["0.0", None, "-0.0", "1e-13", "123456789012345.0", "1234567890123456.0", "-12345678901.5", None, None, None, "1000.0", None, None, None]
    assert df.select(typed.parse_float(F.col("c")).alias("v"))._jdf.queryExecution().analyzed().toString().count("length(c#") == 1
