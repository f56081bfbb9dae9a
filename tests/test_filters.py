import datetime
import json

import pytest
from pyspark.sql import functions as F

from orrery.operators.filters import And, AnyEquals, Custom, Equals, Or, field, folded, from_wire, matches, on_struct, on_variant, to_wire

SCHEMA = "Title string, Views int, BigNumber bigint, Rating double, Weight float, Published boolean, Missing string, Tags array<string>, Numbers array<int>, Metadata struct<Category:string, Nested:struct<Code:string>>"
ROW = ("Kestrel", 42, 5_000_000_000, 4.5, 3.14, True, None, ["science", "linq", "città"], [1, 2, 3], ("article", ("X9",)))
DOC = {"Title": "Kestrel", "Views": 42, "BigNumber": 5_000_000_000, "Rating": 4.5, "Published": True, "Missing": None, "Tags": ["science", "linq", "città"], "Numbers": [1, 2, 3], "Metadata": {"Category": "article", "Nested": {"Code": "X9"}}}

CASES = [
    (Equals("Title", "Kestrel"), True), (Equals("Title", "kestrel"), False), (Equals("title", "Kestrel"), False), (Equals("DoesNotExist", "x"), False),
    (Equals("Metadata.Category", "article"), True), (Equals("Metadata.Nested.Code", "X9"), True), (Equals("Metadata.Nested.Code", "x9"), False),
    (Equals("Metadata.Nope.Code", "X9"), False), (Equals("Title.Sub", "x"), False), (Equals("Views", 42), True), (Equals("Views", 42.0), True),
    (Equals("Views", "42"), False), (Equals("BigNumber", 5_000_000_000), True), (Equals("BigNumber", 5), False), (Equals("Rating", 4.5), True),
    (Equals("Rating", 4), False), (Equals("Published", True), True), (Equals("Published", "true"), False), (Equals("Missing", None), True),
    (Equals("Title", None), False), (Equals("DoesNotExist", None), False), (Equals("Title", datetime.datetime(2024, 1, 1)), False),
    (AnyEquals("Tags", "città"), True), (AnyEquals("Tags", "SCIENCE"), False), (AnyEquals("Numbers", 2), True), (AnyEquals("Title", "Kestrel"), False),
    (AnyEquals("Nope", "x"), False), (And(Equals("Views", 42), Equals("Title", "x")), False), (Or(Equals("Views", 42), Equals("Title", "x")), True),
    (Custom(lambda d: d["Views"] > 40), True), (Custom(lambda d: d["Nope"] > 40), False), (None, True), (Equals("Views", 2**70), False),
]


def test_truth_table_on_struct_and_variant(spark):
    rows = spark.createDataFrame([ROW], SCHEMA)
    docs = spark.createDataFrame([(json.dumps(DOC),)], "s string").select(F.parse_json("s").alias("content"))
    struct = rows.select(*[matches(f, rows.schema).alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    variant = docs.select(*[on_variant(f).alias(f"c{i}") for i, (f, _) in enumerate(CASES)]).first()
    for i, (f, want) in enumerate(CASES):
        assert struct[i] is want, f"struct {f!r}"
        assert variant[i] is want, f"variant {f!r}"
    for f, want in CASES:
        assert rows.where(on_struct(f, rows.schema)).count() == want, f"where {f!r}"


def test_double_literal_compares_with_a_float_in_float_space(spark):
    rows = spark.createDataFrame([ROW], SCHEMA)
    assert rows.where(on_struct(Equals("Weight", 3.14), rows.schema)).count() == 1


def test_garbage_content_never_matches(spark):
    docs = spark.createDataFrame([("not json",), (None,)], "s string").select(F.try_parse_json("s").alias("content"))
    assert docs.where(on_variant(Equals("a", 1))).count() == 0
    assert docs.where(on_variant(None)).count() == 2


def test_long_property_name(spark):
    name = "p" * 100
    docs = spark.createDataFrame([(json.dumps({name: 7}),)], "s string").select(F.parse_json("s").alias("content"))
    assert docs.where(on_variant(Equals(name, 7))).count() == 1


def test_unsupported_comparisons_raise():
    for bad in (lambda: field("a") > 1, lambda: field("a") != 1, lambda: bool(field("a") == 1)):
        with pytest.raises(ValueError):
            bad()


def test_wire_round_trip_and_text():
    f = (field("a.b") == 1) & (field("tags").any("x") | (field("c") == None))  # noqa: E711
    assert repr(from_wire(to_wire(f))) == repr(f) == "(a.b == 1 && (tags.Any(x => x == x) || c == null))"
    assert from_wire(to_wire(None)) is None
    with pytest.raises(ValueError):
        to_wire(Custom(lambda d: True))


def test_constants_fold():
    f = Equals("a", 1)
    assert folded(And(f, False)) is False and folded(Or(f, True)) is True and folded(And(True, f)) is f and folded(And(None, f)) is f
