import json

from pyspark.sql import functions as F

from scopekit import fixed_values as FV
from scopekit.functions.records import clip, random_record, record_json, trim_marker
from scopekit.operators.outputs import records_or_stub, validate_responses

BASE = {"scope_1": 1, "scope_2": None, "scope_3": 3, "sources": [1, 2]}


def j(**kw):
    d = dict(BASE)
    d.update(kw)
    return json.dumps(d, separators=(",", ":"))


# (text, valid, parsed sources when valid)
VALIDATION = [
    (j(), True, [1, 2]),
    (j(sources=[1, 1, 2]), True, [1, 2]),
    (j(sources=[6, 5, 4, 3, 2, 1]), False, None),
    (j(sources=[1, 1, 2, 2, 3, 4, 5]), True, [1, 2, 3, 4, 5]),
    ('{"scope_1":1.0,"scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ('{"scope_1":"1","scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ('{"scope_1":true,"scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ('{"scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":null}', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1,null]}', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1],"extra":"x"}', True, [1]),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1]} trailing', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1]}{"a":1}', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1],"n":{"a":"}"}}', True, [1]),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1],"n":{"a":1}}{"b":{}}', False, None),
    ('  {"scope_1":-5,"scope_2":null,"scope_3":3,"sources":[]}\n', True, []),
    ('{"scope_1":123456789012345678901,"scope_2":null,"scope_3":3,"sources":[1]}', True, [1]),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[%s]}' % ",".join(str(10 ** 18 + i) for i in range(6)), False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[%s]}' % ",".join(str(10 ** 40 + i % 5) for i in range(9)), True, [2 ** 63 - 1]),
    ('{"scope_1":"1000000000000000000","scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ('{"scope_1":1000000000000000000.0,"scope_2":null,"scope_3":3,"sources":[1]}', False, None),
    ("{'scope_1':1,'scope_2':null,'scope_3':3,'sources':[1]}", False, None),
    ('[1]', False, None),
    ('not json', False, None),
    ('', False, None),
    ('{"scope_1":1,"scope_2":null,"scope_3":3,"sources":[1,2]', False, None),
    ('{"scope_1":1,"scope_1":2,"scope_2":null,"scope_3":3,"sources":[7]}', True, [7]),
]


def test_strict_validation_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(VALIDATION)], "i int, response string")
    got = {r.i: (r.valid, r.sources) for r in validate_responses(df).collect()}
    for i, (text, valid, sources) in enumerate(VALIDATION):
        assert got[i] == (valid, sources), text


def test_repeated_key_keeps_last_value(spark):
    df = spark.createDataFrame([('{"scope_1":1,"scope_1":2,"scope_2":null,"scope_3":3,"sources":[7]}',)],
                               "response string")
    assert validate_responses(df).first().scope_1 == 2


def test_invalid_output_becomes_stub(spark):
    df = spark.createDataFrame([(1, j() + "</s>"), (2, "garbage")], "i int, response string")
    got = {r.i: (r.status, r.scope_1, r.sources) for r in records_or_stub(df).collect()}
    assert got == {1: ("ok", 1, [1, 2]), 2: ("failed", -1, [-1])}


def test_trim_marker_cuts_once(spark):
    df = spark.createDataFrame([("x</s></s>",), ("x",), ("</s>",)], "t string")
    assert [r[0] for r in df.select(trim_marker("t")).collect()] == ["x</s>", "x", ""]


def test_clip(spark):
    df = spark.createDataFrame([(-5,), (2000000000,), (None,), (7,)], "v bigint")
    assert [r[0] for r in df.select(clip("v")).collect()] == [-1, 1000000000, None, 7]
    again = df.select(clip("v").alias("v")).select(clip("v")).collect()
    assert [r[0] for r in again] == [-1, 1000000000, None, 7]  # idempotent


def test_record_json_is_compact_with_nulls(spark):
    df = spark.createDataFrame([(581, 1220, None, [16, 17, 56, 7])],
                               "scope_1 bigint, scope_2 bigint, scope_3 bigint, sources array<bigint>")
    assert df.select(record_json()).first()[0] == \
        '{"scope_1":581,"scope_2":1220,"scope_3":null,"sources":[16,17,56,7]}'


def test_stub_text_is_the_fixed_value(spark):
    from scopekit.functions.records import stub_struct
    out = spark.range(1).select(F.to_json(stub_struct(), {"ignoreNullFields": "false"})).first()[0]
    assert out == FV.STUB_JSON


def test_random_record_is_reproducible_and_in_range(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("id"))
    a = df.select("id", random_record("id").alias("r"))
    b = df.repartition(7).select("id", random_record("id").alias("r"))
    ra = {r.id: r.r for r in a.collect()}
    rb = {r.id: r.r for r in b.collect()}
    assert ra == rb
    for r in ra.values():
        for k in ("scope_1", "scope_2", "scope_3"):
            assert 0 <= r[k] < 10 ** FV.REJECTED_MAX_EXPONENT
        assert len(r["sources"]) == 1 and 0 <= r["sources"][0] <= FV.REJECTED_MAX_PAGE


def test_long_integers_are_exact_to_64_bits(spark):
    values = [10 ** 18, -10 ** 18, 2 ** 63 - 1, -2 ** 63, 2 ** 63, -2 ** 63 - 1, 10 ** 30, 123, None, -10 ** 45]
    rows = [(i, j(scope_1=v, scope_3=v, note="long, 1234567890123456789012")) for i, v in enumerate(values)]
    got = {r.i: (r.valid, r.scope_1, r.scope_3) for r in validate_responses(spark.createDataFrame(rows, "i int, response string")).collect()}
    for i, v in enumerate(values):
        want = v if v is None else max(-2 ** 63, min(2 ** 63 - 1, v))
        assert got[i] == (True, want, want), values[i]


def test_record_json_of_doubles(spark):
    """NaN is missing; whole parts are kept, also beyond 64 bits."""
    df = spark.createDataFrame([(float("nan"), 1.9, 1e19, [1.0, -2.7])], "scope_1 double, scope_2 double, scope_3 double, sources array<double>")
    assert df.select(record_json()).first()[0] == '{"scope_1":null,"scope_2":1,"scope_3":10000000000000000000,"sources":[1,-2]}'
