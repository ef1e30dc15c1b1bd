import pytest

from featloom.plans import batch_features as B, documents as D, feature_store as S

NOW = "2024-02-01 12:00:00"


@pytest.fixture
def shop(table):
    customers = table("customer_id string, email string, created_at timestamp_ntz", [
        ("none", "a", "2024-01-01 00:00:00"), ("old", "b", "2023-01-01 00:00:00"),
        ("edge", "c", "2023-06-01 23:59:59"), ("both", "d", "2023-01-01 00:00:00"),
        ("undated", "e", "2023-01-01 00:00:00")])
    purchases = table(
        "purchase_id string, customer_id string, amount decimal(12,2), created_at timestamp_ntz", [
            ("p1", "old", "5.00", "2023-05-01 00:00:00"),
            ("p2", "edge", "10.00", "2024-01-02 12:00:00"),   # exactly 30 days before
            ("p3", "both", "1.00", "2023-05-01 00:00:00"),
            ("p4", "both", "2.50", "2024-01-31 23:59:59"),
            ("p5", "both", None, "2024-01-20 00:00:00"),
            ("p6", "undated", "7.00", None),
            ("p7", None, "9.00", "2024-01-31 00:00:00"),
            ("p8", "stranger", "9.00", "2024-01-31 00:00:00")])
    items = table("purchase_id string, product_id string, quantity int", [
        ("p1", "lamp", 1), ("p4", "desk", 2), ("p5", "desk", 3), ("p4", "lamp", 1), ("ghost", "chair", 4),
        ("p8", "desk", 1)])
    products = table("product_id string, name string, price decimal(10,2), created_at timestamp_ntz", [
        ("lamp", "l", "3.00", "2023-01-01 00:00:00"), ("desk", "d", "100.00", "2024-01-01 00:00:00"),
        ("desk", "d", "90.00", "2024-01-05 00:00:00"), ("unsold", "u", "1.00", "2024-01-31 23:59:59"),
        ("chair", "c", "5.00", "2024-01-01 00:00:00")])
    return {"customers": customers, "purchases": purchases, "purchase_items": items, "products": products}


def test_customers(shop, rows):
    got = {r[0]: r[2:] for r in rows(B.customer_features(shop["customers"], shop["purchases"], NOW))}
    assert got == {
        "none": (0, None, None, None, 31),
        "edge": (1, 10.0, 10.0, 30, 245),
        "both": (2, 2.5, 2.5, 1, 396),          # NULL amount counts as a purchase, not in the mean
        "undated": (1, 7.0, 7.0, None, 396),    # a purchase without a date passes the filter
    }


def test_customers_keep_inactive(shop, rows):
    got = {r[0]: r[2:4] for r in rows(B.customer_features(
        shop["customers"], shop["purchases"], NOW, keep_inactive=True))}
    assert got["old"] == (0, None) and got["none"] == (0, None) and got["both"] == (2, 2.5)


def test_lookback_names(shop):
    cols = B.customer_features(shop["customers"], shop["purchases"], NOW, 7).columns
    assert "customer_purchase_count_7d" in cols and "customer_total_purchases_7d" in cols


def test_products(shop, rows):
    got = {r[0]: r[2:] for r in rows(B.product_features(
        shop["products"], shop["purchase_items"], shop["purchases"], NOW))}
    assert got["unsold"] == (0, None, None, None, 1)
    assert got["chair"] == (1, 4, 20.0, None, 31)               # item of an unknown purchase: no date, kept
    assert got["lamp"] == (1, 1, 3.0, 1, 396)
    # two prices: one row, each sale counted at each price
    assert got["desk"] == (6, 12, 6 * 190.0, 1, 31)


def test_items_meet_their_purchases_in_one_join(shop):
    plan = B.product_features(shop["products"], shop["purchase_items"], shop["purchases"], NOW)._jdf.queryExecution().optimizedPlan().toString()
    on_purchases = [line for line in plan.splitlines() if "Join" in line and "purchase_id" in line]
    assert len(on_purchases) == 1, plan


def test_pairs(shop, rows):
    got = rows(B.customer_product_features(
        shop["customers"], shop["products"].dropDuplicates(["product_id"]), shop["purchases"],
        shop["purchase_items"], NOW, 30), "entity_id")
    assert got == [("both:desk", "customer_product", 2, 5, 1), ("both:lamp", "customer_product", 1, 1, 1)]


def test_run(shop):
    frames = B.run(shop, ["customer", "product"], 7, NOW)
    assert list(frames) == ["customer", "product"]
    with pytest.raises(ValueError):
        B.run(shop, ["user"], 7, NOW)


@pytest.fixture
def store(table):
    users = table("user_id string, username string, email string, created_at timestamp_ntz, "
                  "updated_at timestamp_ntz, last_login timestamp_ntz", [
        ("user-1", "johndoe", "j@x", "2024-01-01 00:00:00", "2024-01-31 12:00:00", None),
        ("user-2", "janedoe", "k@x", "2024-01-01 00:00:00", "2024-01-31 12:00:01", "2024-01-31 00:00:00"),
        ("user-3", "bobsmith", "b@x", "2024-01-30 12:00:00", "2024-02-01 00:00:00", None)])
    products = table("product_id string, name string, description string, price decimal(12,2), inventory int, "
                     "category string, created_at timestamp_ntz, updated_at timestamp_ntz", [
        ("prod-1", "Laptop", None, "1299.99", 10, "Electronics", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
        ("prod-2", "Phone", None, "799.99", 25, "Electronics", "2024-01-01 00:00:00", "2024-02-01 00:00:00"),
        ("prod-3", "Headphones", None, "199.99", 50, "Audio", "2024-01-01 00:00:00", "2024-02-01 00:00:00")])
    orders = table("order_id string, user_id string, order_date timestamp_ntz, status string, "
                   "total_amount decimal(12,2), created_at timestamp_ntz, updated_at timestamp_ntz", [
        ("order-1", "user-1", "2024-01-31 00:00:00", "COMPLETED", "1299.99", "2024-01-31 00:00:00", "2024-02-01 00:00:00"),
        ("order-2", "user-2", "2024-02-01 00:00:00", "PROCESSING", "999.98", "2024-02-01 00:00:00", "2024-02-01 00:00:00"),
        ("order-3", "user-2", "2023-02-01 00:00:00", "COMPLETED", "0.02", "2024-02-01 00:00:00", "2023-02-01 00:00:00")])
    items = table("order_item_id int, order_id string, product_id string, quantity int, price decimal(12,2)", [
        (1, "order-1", "prod-1", 1, "1299.99"), (2, "order-2", "prod-3", 1, "199.99"),
        (3, "order-2", "prod-2", 1, "799.99")])
    return {"users": users, "products": products, "orders": orders, "order_items": items}


def test_user_vectors(store, rows):
    got = rows(B.user_vectors(store["users"], store["orders"], store["order_items"], store["products"], as_of=NOW),
               "user_id")
    assert got == [("user-1", 1, 1299.99, 1299.99, 1.5, 1, 0),
                   ("user-2", 2, 1000.0, 500.0, 0.5, 1, 1),
                   ("user-3", 0, 0.0, 0.0, 2.0, 0, 0)]     # no order: days since the account was made


def test_documents(store, rows):
    import json

    got = {k: json.loads(v) for k, v, _ in rows(D.user_documents(store["users"], NOW))}
    assert set(got) == {"user:user-2", "user:user-3"}       # exactly one day ago is not newer than a day
    assert got["user:user-3"]["last_login"] is None
    product = json.loads(rows(D.product_documents(store["products"], NOW), "doc_key")[0][1])
    assert product["price"] == 1299.99 and product["description"] is None
    orders = rows(D.order_documents(store["orders"], store["order_items"], NOW), "doc_key")
    assert [r[0] for r in orders] == ["order:order-1", "order:order-1:items:0", "order:order-2", "order:order-2:items:0"]
    second = json.loads(orders[2][1])
    assert second["total_amount"] == 999.98 and second["order_date"] == "2024-02-01T00:00:00"
    assert (second["item_count"], second["parts"]) == (2, 1)
    assert json.loads(orders[3][1])["items"] == [{"product_id": "prod-2", "quantity": 1, "price": 799.99},
                               {"product_id": "prod-3", "quantity": 1, "price": 199.99}]


def test_large_order_is_told_in_pages(store, spark, rows):
    import json

    many = spark.range(1000).selectExpr("cast(id as int) order_item_id", "'order-1' order_id", "'prod-1' product_id",
                                        "cast(id as int) quantity", "cast(1 as decimal(12,2)) price")
    docs = {k: json.loads(d) for k, d, _ in rows(D.order_documents(
        store["orders"], store["order_items"].unionByName(many), NOW, max_items=100))}
    header = docs["order:order-1"]
    assert header["item_count"] == 1001 and header["parts"] == 11
    pages = [d for k, d in docs.items() if k.startswith("order:order-1:items:")]
    assert max(len(p["items"]) for p in pages) < 250 and len({p["part"] for p in pages}) == len(pages)
    assert sorted(i["quantity"] for p in pages for i in p["items"]) == sorted([1, *range(1000)])
    assert docs["order:order-2"]["parts"] == 1 and "order:order-2:items:0" in docs


def test_documents_keep_microseconds(table, rows):
    import json

    users = table("user_id string, username string, email string, created_at timestamp_ntz, updated_at timestamp_ntz, "
                  "last_login timestamp_ntz", [("u", "n", "e", "2024-01-31 00:00:00", "2024-02-01 10:00:00.123456", None)])
    got = json.loads(rows(D.user_documents(users, NOW))[0][1])
    assert got["updated_at"] == "2024-02-01T10:00:00.123456" and got["created_at"] == "2024-01-31T00:00:00"


def test_sync_totals(store, rows):
    got = D.sync_all(store, NOW).groupBy("entity").count()
    assert dict(rows(got)) == {"user": 2, "product": 3, "order": 2, "order_items": 2, "user_features": 3}


def test_features_to_online(shop, rows):
    wide = B.customer_features(shop["customers"], shop["purchases"], NOW)
    online = S.store_features_batch(wide, "customer", NOW)
    got = {(r["entity_id"], r["feature_name"]): r["value"] for r in online.collect()}
    assert ("none", "customer_total_purchases_30d") not in got       # NULL is not stored
    assert got["none", "customer_purchase_count_30d"] == "0"
    assert got["both", "customer_total_purchases_30d"] == "2.5"
    assert str(online.first()["expires_at"]) == "2024-02-08 12:00:00"
