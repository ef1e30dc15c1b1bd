import pytest
from pyspark.sql import functions as F

from featloom.plans import definitions as D, registry as R
from featloom.schemas import VERSIONS

NOW = "2024-02-01 00:00:00"


@pytest.fixture
def events(table):
    return table("customer_id string, product_id string, event_type string, event_timestamp timestamp_ntz", [
        ("a", "p", "view", "2024-01-30 23:59:59"), ("a", "p", "purchase", "2024-01-31 00:00:01"),
        ("a", "q", "purchase", "2024-01-31 10:00:00"), ("b", "q", "add_to_cart", "2024-01-01 00:00:00")])


def test_customer_definitions(events, rows):
    got = rows(D.compute(events, D.CUSTOMER_EVENT_FEATURES, ["customer_id"], NOW), "customer_id")
    assert got == [("a", 1, 3, 2, 1.0), ("b", 31, 1, 1, 0.0)]


def test_filtered_date_diff_and_a_column_as_now(table, rows):
    from pyspark.sql import functions as F
    df = table("customer_id string, purchase_date timestamp_ntz, kind string", [
        ("a", "2024-01-23 00:00:00", "x"), ("a", "2024-01-31 00:00:00", "y")])
    ds = [D.Definition("days", "customer", "INT", ({"type": "date_diff", "from": "NOW()", "to": "MAX(purchase_date)"},),
                       {"filter": "kind = 'x'"}),
          D.Definition("recent", "customer", "INT", ({"type": "count", "field": "*"},),
                       {"filter": "purchase_date >= NOW() - INTERVAL '10 days'"}),
          D.Definition("age", "customer", "INT", ({"type": "max", "field": "purchase_date", "alias": "m"},
                                                  {"type": "datediff", "args": ["current_date", "m"]}))]
    for now in (NOW, F.lit(NOW).cast("timestamp_ntz")):
        assert rows(D.compute(df, ds, ["customer_id"], now)) == [("a", 9, 2, 1)]
    with pytest.raises(ValueError):
        D.compute(df, [D.Definition("d", "customer", "INT", ({"type": "date_diff", "from": "NOW()", "to": "purchase_date"},),
                                    {"filter": "kind = 'x'"})], ["customer_id"], NOW)


def test_product_definitions(events, rows):
    got = rows(D.compute(events, D.product_event_features(), ["product_id"], NOW), "product_id")
    assert got == [("p", 1, 1, 0, 1.0), ("q", 0, 1, 1, None)]     # no views: no rate, no error


def test_pairs(events, rows):
    got = rows(D.compute(events, D.customer_product_event_features(), ["customer_id", "product_id"], NOW),
               "customer_id", "product_id")
    assert got[1] == ("a", "q", 1, 0, 0, 1)


def test_source_filter_and_now(table, rows):
    df = table("customer_id string, purchase_amount decimal(12,2), purchase_date timestamp_ntz", [
        ("a", "5.00", "2024-01-02 00:00:00"), ("a", "7.00", "2024-01-01 23:59:59"), ("b", "1.00", "2023-01-01 00:00:00")])
    got = rows(D.compute(df, D.CUSTOMER_PURCHASE_FEATURES, ["customer_id"], NOW), "customer_id")
    assert got == [("a", 5.0, 30), ("b", None, 396)]


def test_one_aggregation_for_all(events):
    plan = D.compute(events, D.CUSTOMER_EVENT_FEATURES, ["customer_id"], NOW)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in text and text.count("count(distinct") == 1


def test_bad_definitions(events):
    with pytest.raises(ValueError):
        D.compute(events, [D.Definition("x", "customer", "INT", ({"type": "cube"},))], ["customer_id"])
    with pytest.raises(ValueError):
        D.compute(events, [D.Definition("x", "customer", "INT", ())], ["customer_id"])
    with pytest.raises(ValueError):
        D.compute(events, [*D.CUSTOMER_EVENT_FEATURES, *D.product_event_features()], ["customer_id"])
    with pytest.raises(KeyError):
        D.compute(events, [D.Definition("x", "c", "INT", ({"type": "aggregation", "function": "shell", "column": "1"},))],
                  ["customer_id"])


def test_sample_groups_name_known_definitions():
    names = {d.name for d in (*D.CUSTOMER_EVENT_FEATURES, *D.product_event_features(), *D.customer_product_event_features())}
    assert len(names) == 12
    assert {f for g in D.FEATURE_GROUPS.values() for f in g} <= names


# registry ------------------------------------------------------------------------
SCHEMA = (f"name string, description string, entity_type string, value_type string, source string, category string, "
          f"frequency string, owner string, versions {VERSIONS}, created_at timestamp_ntz, updated_at timestamp_ntz")


def definition(name, value_type="INT", category="RAW", versions=()):
    return (name, "d", "customer", value_type, "BATCH", category, "DAILY", "o", [(v, "ACTIVE", None) for v in versions],
            "2023-01-01 00:00:00", "2023-01-01 00:00:00")


@pytest.fixture
def registry(table):
    return table(SCHEMA, [definition("a", versions=[1, 4]), definition("b", category="DERIVED", versions=[1]),
                          definition("c")])


def test_register(registry, table, rows):
    incoming = table(SCHEMA, [definition("a"), definition("new"), definition("bad", value_type="TENSOR"), definition("alias", "INTEGER"),
                              definition("bad2", category="ODD"), definition("")])
    got = {r["name"]: (r["status_code"], r["reason"]) for r in R.check_new(incoming, registry).collect()}
    assert got == {"a": (409, "already exists"), "new": (201, None), "bad": (422, "value_type"), "alias": (201, None),
                   "bad2": (422, "category"), "": (422, "name")}
    after = {r["name"]: r for r in R.register(incoming, registry, NOW).collect()}
    assert set(after) == {"a", "b", "c", "new", "alias"}
    assert [(v["version"], v["status"]) for v in after["new"]["versions"]] == [(1, "ACTIVE")]
    assert str(after["new"]["updated_at"]) == NOW and str(after["a"]["updated_at"]) == "2023-01-01 00:00:00"


def test_repeated_names_in_a_batch(registry, table):
    incoming = table(SCHEMA, [definition("new", "FLOAT"), definition("new", "INT"), definition("new", "TENSOR"), definition("a")])
    got = sorted((r["name"], r["value_type"], r["status_code"]) for r in R.check_new(incoming, registry, ["value_type"]).collect())
    assert got == [("a", "INT", 409), ("new", "FLOAT", 201), ("new", "INT", 409), ("new", "TENSOR", 422)]
    after = R.register(incoming, registry, NOW, ["value_type"])
    assert after.filter("name = 'new'").count() == 1 and after.select("name").distinct().count() == after.count()
    known = table(GROUP, [("old", "d", ["a"], "customer", "o", None, None)])
    groups = table(GROUP, [("g", "1", ["a", "x"], "m", "o", None, None), ("g", "2", ["a"], "m", "o", None, None),
                           ("g", "3", ["b"], "m", "o", None, None)]).drop("created_at", "updated_at")
    got = {r["description"]: (r["status_code"], r["missing"]) for r in R.check_groups(groups, registry, known, ["description"]).collect()}
    assert got == {"1": (404, ["x"]), "2": (201, None), "3": (409, None)}
    assert R.register_groups(groups, registry, known, NOW).count() == 2


def test_whole_registry(registry, table, tmp_path, spark):
    groups = table(GROUP, [("g", "d", ["a"], "customer", "o", None, None), ("h", "d", ["b"], "product", "p", None, None)])
    R.store(registry, groups, str(tmp_path / "f"), str(tmp_path / "g"))
    features, known = R.load(spark, str(tmp_path / "f"), str(tmp_path / "g"))
    assert features.count() == 3 and R.get(known, "h").first()["owner"] == "p"
    assert [r["name"] for r in R.list_groups(known, "customer").collect()] == ["g"] and R.list_groups(known).count() == 2


def test_versions(registry, table):
    grown = {r["name"]: r for r in R.add_versions(registry, table("name string", [("a",), ("c",), ("ghost",)]), NOW).collect()}
    assert [v["version"] for v in grown["a"]["versions"]] == [1, 4, 5]
    assert [v["version"] for v in grown["c"]["versions"]] == [1] and len(grown["b"]["versions"]) == 1
    assert str(grown["b"]["updated_at"]) == "2023-01-01 00:00:00" and str(grown["c"]["updated_at"]) == NOW
    assert R.versions_with_status(registry).count() == 3


def test_list_get_delete_save(registry, table, rows):
    assert [r["name"] for r in R.list_features(registry, category="DERIVED").collect()] == ["b"]
    assert R.list_features(registry, "product").count() == 0 and R.list_features(registry).count() == 3
    assert R.get(registry, "a").count() == 1
    remaining, outcome = R.delete(registry, table("name string", [("a",), ("ghost",)]))
    assert sorted(r["name"] for r in remaining.collect()) == ["b", "c"]
    assert dict(rows(outcome)) == {"a": True, "ghost": False}
    saved = {r["name"]: r for r in R.save(registry, table(SCHEMA, [definition("a", "FLOAT")]), NOW).collect()}
    assert saved["a"]["value_type"] == "FLOAT" and str(saved["a"]["updated_at"]) == NOW and len(saved) == 3


GROUP = ("name string, description string, feature_names array<string>, entity_type string, owner string, "
         "created_at timestamp_ntz, updated_at timestamp_ntz")


def test_groups(registry, table):
    known = table(GROUP, [("old", "d", ["a"], "customer", "o", None, None)])
    new = table(GROUP, [("fine", "d", ["a", "b"], "mixed", "o", None, None), ("lost", "d", ["a", "x", "y", "x"], "customer", "o", None, None),
                        ("old", "d", ["b"], "customer", "o", None, None)]).drop("created_at", "updated_at")
    got = {r["name"]: (r["status_code"], r["missing"]) for r in R.check_groups(new, registry, known).collect()}
    assert got == {"fine": (201, None), "lost": (404, ["x", "y"]), "old": (409, None)}
    after = R.register_groups(new, registry, known, NOW)
    assert sorted(r["name"] for r in after.collect()) == ["fine", "old"]
    members = R.group_features(after, registry)
    assert sorted((r["group_name"], r["name"]) for r in members.collect()) == [("fine", "a"), ("fine", "b"), ("old", "a")]


def test_grains_share_one_read(spark):
    """Features of all entity types from one read are those of a read for each."""
    import random

    from featloom.functions.keys import ENTITY_IDS
    from featloom.plans import definitions as D, golden

    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None]), r.choice([7, 8, None]), r.choice(["view", "purchase", "add_to_cart", None]),
             f"2024-01-{r.randint(1, 9):02} 0{r.randint(0, 9)}:00:00") for _ in range(400)]
    df = spark.createDataFrame(rows, "customer_id bigint, product_id bigint, event_type string, event_timestamp string").withColumn(
        "event_timestamp", F.col("event_timestamp").cast("timestamp_ntz"))
    grains = [(ids, D.of_registry(golden.DEFINITIONS, kind)) for kind, ids in ENTITY_IDS.items()]
    seen = []
    shared = D.compute_grains(df, grains, "2024-02-01")
    for (ids, definitions), got in zip(grains, shared):
        want = D.compute(df, definitions, ids, "2024-02-01")
        assert got.dtypes == want.dtypes
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        seen += got.columns
    assert {d["name"] for d in golden.DEFINITIONS} <= set(seen)
    assert len({f for g in shared for f in g.inputFiles()} - set(shared[0].inputFiles())) == 0
    wrong = D.Definition("x", "customer", "FLOAT", ({"type": "avg", "field": "product_id"},))
    with pytest.raises(ValueError, match="cannot be merged"):
        D.compute_grains(df, [(["customer_id"], [wrong])])


def test_groups_are_checked_once(spark):
    """The names of all groups are looked up once, whatever parts of the batch the result is made of."""
    groups = spark.createDataFrame([("a", ["f", None]), ("a", ["f"]), ("b", ["g", "f"]), (None, ["f"]), (None, ["f"])],
                                   "name string, feature_names array<string>")
    checked = R.check_groups(groups, spark.createDataFrame([("f",)], "name string"), spark.createDataFrame([], "name string"))
    assert "explode(feature_names" not in checked._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["name"] or "", r["missing"] or [], r["status_code"]) for r in checked.collect()) == [
        ("", [], 201), ("", [], 201), ("a", [], 201), ("a", [], 409), ("b", ["g"], 404)]
