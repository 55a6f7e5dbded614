"""Request bodies as JSON text, from parsing to the writes."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from halyard.operators import changes as CH
from halyard.operators.validation import VALIDATORS
from halyard.sources.requests import BODY_BYTES, FIELDS, parse_requests, read_bodies, to_bodies

T = dt.datetime(2024, 6, 1)


def parsed(spark, entity, bodies, partial=False):
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "row_id bigint, body string")
    return parse_requests(rows, entity, partial)


def errors(df):
    return [r["json_errors"] for r in df.orderBy("row_id").collect()]


def test_absent_and_null_differ(spark):
    got = parsed(spark, "customers", ['{"phone": null}', "{}", '{"phone": "5"}', '{"PHONE": "5", "other": 1}'], partial=True)
    rows = got.orderBy("row_id").select("set_phone", "phone", "set_email", "json_errors").collect()
    assert [tuple(r) for r in rows] == [(True, None, False, []), (False, None, False, []), (True, "5", False, []), (False, None, False, [])]


def test_bodies_that_are_no_object(spark):
    bodies = ["", None, "  ", "null", "[1]", "7", '"x"', "{", '{"a": 1, "a": 2}', '{"notes": "%s"}' % ("x" * BODY_BYTES)]
    got = errors(parsed(spark, "customers", bodies, partial=True))
    assert got == [[], [], []] + [["body:json"]] * 6 + [["body:too_large"]]


@pytest.mark.parametrize("entity", sorted(FIELDS))
def test_every_field_of_another_type_is_told(spark, entity):
    """Each field once with every JSON type, against Python's."""
    values = [None, True, 1, 2.5, 1e300, -3, "text", [], ["a"], ["a", None], [1], {"a": 1}]
    right = {"text": lambda v: isinstance(v, str), "flag": lambda v: isinstance(v, bool),
             "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
             "whole": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) and abs(v) < 2 ** 63,
             "texts": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)}
    code = {"text": "string", "flag": "boolean", "number": "number", "whole": "integer", "texts": "strings"}
    cases = [(name, col, kind, null, v) for name, col, kind, null in FIELDS[entity] for v in values]
    got = parsed(spark, entity, [json.dumps({name: v}) for name, _, _, _, v in cases], partial=True).orderBy("row_id").collect()
    for (name, col, kind, null, v), r in zip(cases, got):
        if v is None:
            want = [] if null else [f"{col}:required"]
        else:
            want = [] if right[kind](v) else [f"{col}:{code[kind]}"]
        assert r["json_errors"] == want and r[f"set_{col}"], (name, v, r)
        assert r[col] == (v if not want and v is not None else None), (name, v, r)


def test_codes_of_body_and_rules_together(spark):
    got = parsed(spark, "customers", [
        '{"firstName": 5, "lastName": "", "email": "a@b.org"}', "oops",
        '{"firstName": "A", "lastName": "B", "email": "a@b.org", "packageAssignment": {"packageId": "x", "pricePaid": -1}}',
        '{"firstName": "A", "lastName": "B", "email": "a@b.org", "packageAssignment": null}'])
    checked = VALIDATORS["customers"](got, checked_only=True).checked().orderBy("row_id").collect()
    assert [r["errors"] for r in checked] == [
        ["first_name:string", "last_name:too_short"], ["body:json"],
        ["subscription.package_id:integer", "subscription.expires_at:required", "subscription.price_paid:too_small"], []]


def test_nested_create_from_text(spark, demo):
    good = {"firstName": "A", "lastName": "B", "email": "a@b.org", "companyId": 1,
            "packageAssignment": {"packageId": 1, "expiresAt": "2024-07-01T00:00:00.5Z", "pricePaid": 9.5}}
    bad = {**good, "email": "c@b.org", "packageAssignment": {"packageId": 1.5, "expiresAt": "2024-07-01T00:00:00Z"}}
    rows = parsed(spark, "customers", [json.dumps(good), json.dumps(bad), "{"])
    customers, subs, rejected = CH.create_with_subscription(demo, rows, T)
    assert [r["email"] for r in customers.collect()] == ["a@b.org"] and [str(r["price_paid"]) for r in subs.collect()] == ["9.50"]
    assert {r["row_id"]: r["errors"] for r in rejected.collect()} == {1: ["subscription.package_id:integer"], 2: ["body:json"]}


def test_inserts_from_text_files_and_as_a_stream(spark, demo, tmp_path):
    lines = ['{"name": "New", "price": 5, "durationDays": 30, "features": ["a", "b"]}', "broken", "",
             '{"name": "Free", "price": 0, "durationDays": 30.5}', '{"name": "Off", "price": 1.25, "durationDays": 1, "active": false}']
    path = tmp_path / "in"
    path.mkdir()
    (path / "one.txt").write_text("\n".join(lines) + "\n")
    rows = read_bodies(spark, str(path)).withColumn("row_id", F.monotonically_increasing_id())
    new, rejected = CH.insert_batch(demo, parse_requests(rows, "packages"), "packages", T)
    got = sorted((r["name"], str(r["price"]), r["duration_days"], r["features"], r["active"]) for r in new.collect())
    assert got == [("New", "5.00", 30, ["a", "b"], True), ("Off", "1.25", 1, None, False)]
    assert sorted(r["errors"] for r in rejected.collect()) == [
        ["body:json"], ["duration_days:integer"], ["name:required", "price:required", "duration_days:required"]]
    stream = parse_requests(read_bodies(spark, str(path), stream=True).withColumn("row_id", F.lit(1).cast("bigint")), "packages")
    checked = VALIDATORS["packages"](stream, checked_only=True).checked()
    query = (checked.select("name", F.concat_ws("|", "errors").alias("errors")).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["errors"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted([
        "", "", "body:json", "duration_days:integer", "name:required|price:required|duration_days:required"])


def test_round_trip(spark, demo):
    for entity in FIELDS:
        if entity == "promotions" or entity == "customer_packages":
            continue    # their date-times are timestamps in the tables
        columns = [c for _, c, _, _ in FIELDS[entity]]
        rows = demo[entity].select(F.col("id").alias("row_id"), *columns)
        back = parse_requests(to_bodies(rows, entity), entity)
        assert back.where(F.size("json_errors") > 0).count() == 0
        want = rows.select("row_id", *[F.col(f.name).cast("double" if f.dataType.simpleString().startswith("decimal") else f.dataType)
                                       for f in rows.select(*columns).schema])
        assert back.select("row_id", *columns).exceptAll(want.select("row_id", *columns)).count() == 0
