"""Column-expression edge rows (FIXTURES section 3)."""

import json

from pyspark.sql import functions as F

from txnflow.domain import BANK_DOMAIN, TESTDATA_DOMAIN, Clause, Rule, rule
from txnflow.functions import flags, rules, text, time_parts
from txnflow.functions.json_leaves import json_leaves, with_parsed


def test_json_leaves_missing_and_invalid(spark):
    good = json.dumps({"action": {"twd_amt": 120.0, "txn_currency_code": "TWD"},
                       "channel": {}, "object": {"target_acct_nbr": "7", "target_bank_code": "013"}})
    rows = [(1, good), (2, '{"object": {"target_bank_code": "812"}}'), (3, "{not json"), (4, None),
            (5, '{"action": {"twd_amt": "abc"}}')]
    df = with_parsed(spark.createDataFrame(rows, "id int, attrs string")).select("id", *json_leaves())
    got = {r["id"]: r.asDict() for r in df.collect()}
    assert got[1]["twd_amt"] == 120.0 and got[1]["txn_currency_code"] == "TWD"
    assert got[1]["atm_location"] is None and got[1]["target_bank_code"] == "013"
    assert got[2]["twd_amt"] is None and got[2]["target_bank_code"] == "812"
    assert all(v is None for k, v in got[3].items() if k != "id")
    assert all(v is None for k, v in got[4].items() if k != "id")
    assert got[5]["twd_amt"] is None  # malformed amount -> null, not an error


def test_time_parts_hours_weekdays_and_zone(spark):
    # 2024-01-05 is a Friday.  Hours 0,1,6,7,12,13,18,19,23 (UTC).
    base = 1704412800  # 2024-01-05 00:00:00 UTC
    hours = [0, 1, 6, 7, 12, 13, 18, 19, 23]
    df = spark.createDataFrame([(base + h * 3600,) for h in hours], "t long")
    out = df.select(*time_parts.time_parts(F.col("t"))).collect()
    assert [r["action_time_hour"] for r in out] == hours
    assert [r["action_time_periodOfDay"] for r in out] == [3, 0, 0, 1, 1, 2, 2, 3, 3]
    assert {r["action_time_dayOfWeek"] for r in out} == {5}
    assert {r["action_time_isWeekend"] for r in out} == {0}
    days = spark.createDataFrame([(base + d * 86400,) for d in range(4)], "t long")
    dows = [r[3] for r in days.select(*time_parts.time_parts(F.col("t"))).collect()]
    assert dows == [5, 6, 7, 1]  # Fri, Sat, Sun, Mon
    # 2024-01-05 20:00 UTC is 2024-01-06 04:00 in Taipei (UTC+8): crosses midnight.
    tz = spark.createDataFrame([(base + 20 * 3600,)], "t long").select(
        *time_parts.time_parts(F.col("t"), "Asia/Taipei")).first()
    assert (tz["action_time_day"], tz["action_time_hour"], tz["action_time_dayOfWeek"]) == (6, 4, 6)
    assert tz["action_time_isWeekend"] == 1


def test_rules_first_match_default_and_amounts(spark):
    table = (rule("a", "x"), rule("b", "x|y"), rule("paid", "z", amount=">0"),
             rule("free", equals="z", amount="=0"),
             Rule("either", (Clause(("p", "q")), Clause(("r",), amount=">0"))))
    rows = [("x y", 5.0), ("y", 5.0), ("nothing", 5.0), ("z", 0.0), ("z", None), ("zz", 3.0),
            ("p q", None), ("r", 0.0), ("r", 1.0)]
    df = spark.createDataFrame(rows, "t string, amt double")
    got = [r[0] for r in df.select(rules.classify(F.col("t"), table, "other", F.col("amt"))).collect()]
    assert got == ["a", "b", "other", "free", "other", "paid", "either", "other", "either"]


def test_bank_domain_rules_compile(spark):
    df = spark.createDataFrame([("unknown _", 0.0), ("跨行轉帳 unknown", 100.0), ("NCWINQ _", 0.0)],
                               "t string, amt double")
    got = [r[0] for r in df.select(rules.classify(F.col("t"), BANK_DOMAIN.action_rules,
                                                  BANK_DOMAIN.action_default, F.col("amt"))).collect()]
    assert got == ["其他_無金額_unknown", "轉帳_個人轉帳", "其他_無金額_NCWINQ"]


def test_cash_flow_cases(spark):
    d = TESTDATA_DOMAIN
    rows = [("self", 10.0, "PROMO red widget", "promo_small_goods"),   # outflow
            ("self", 10.0, "SMALL hot rod", "small"),                    # inflow (no outflow wording)
            ("self", 0.0, "SMALL hot rod", "small"),                     # enquiry with 0
            ("others", 10.0, "PROMO red widget", "promo_small_goods"),  # not self -> inflow
            ("self", 10.0, "LARGE red ring", "large_paid")]              # excluded word -> inflow
    df = spark.createDataFrame(rows, "s string, a double, t string, c string")
    got = [r[0] for r in df.select(flags.cash_flow(F.col("s"), F.col("a"), F.col("t"), F.col("c"), d)).collect()]
    assert got == [-1, 1, 0, 1, 1]


def test_flags_pandas_null_semantics(spark):
    df = spark.createDataFrame([("013", "1", "1", "a", "b"), (None, "1", None, "a", None), ("812", "2", "1", "a", "a")],
                               "bank string, actor string, tcust string, acct string, tacct string")
    out = df.select(flags.is_cross_bank(F.col("bank"), "013").alias("x"),
                    flags.is_self_transfer(F.col("actor"), F.col("tcust"), F.col("acct"), F.col("tacct")).alias("s"),
                    flags.is_exchange_deal(F.col("bank"), ("013",)).alias("e")).collect()
    assert [(r.x, r.s, r.e) for r in out] == [(0, 1, 0), (1, 0, 1), (1, 0, 1)]


def test_segmentation_longest_lexicon_word_wins(spark):
    lex = ("台北", "台北車站", "Brand 1", "Brand 17")
    df = spark.createDataFrame([("台北車站店",), ("Brand 17 red",), ("",), ("aa aa",)], "t string")
    got = [r[0] for r in df.select(text.segment(F.col("t"), lex)).collect()]
    assert got[0] == ["台北車站", "店"]
    assert got[1] == ["Brand 17", " ", "red"]
    assert got[2] == []
    assert got[3] == ["aa", " ", "aa"]  # duplicates kept


def test_location_document_chain(spark):
    df = spark.createDataFrame([("全家—台北車站店",)], "t string")
    doc = df.select(text.location_document(F.col("t"), "—", ("台北車站",), BANK_DOMAIN.stop_words, "店")).first()[0]
    assert doc == "全 家 台北車站"
    words = spark.createDataFrame([("Café crème, a b 12",)], "t string").select(text.analyse(F.col("t"))).first()[0]
    assert words == ["café", "crème", "12"]


def test_one_hot_declared_levels(spark):
    df = spark.createDataFrame([(-1,), (0,), (1,), (None,)], "c int")
    out = df.select(*flags.one_hot(F.col("c"), (-1, 1), "cash_flow")).collect()
    assert [tuple(r) for r in out] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_location_terms_are_those_of_the_document(spark):
    """The chain in one gives the analysed terms of the document, and makes no token for a single character."""
    import random
    rng = random.Random(8)
    parts = ["the", "The", "a", "b7", "Brand 1", "Brand 17", "Brand 175", "red widget", "it's", "don't", "caf\u00e9", "\u0130x", "\u53f0\u5317", "\U0001f600",
             "_", "_a_", " ", " ", "#", "\n", ".", "'", "unknown", "D", "1F", "\u5e97", "x\u5e97y"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for lexicon, stop, fragment in ((("Brand 1", "Brand 17", "it's", "\u53f0\u5317", "b_c d"), ("the", "unknown", "it's"), "'"), ((), (), "a"),
                                    (("x\u5e97y",), ("D", "1F"), "\u5e97"), (("red widget",), ("\u53f0",), "")):
        args = (text.F.col("t"), "#", lexicon, stop, fragment)
        rows = df.select(text.location_terms(*args).alias("new"), text.analyse(text.location_document(*args)).alias("old")).collect()
        assert [r.new for r in rows] == [r.old for r in rows]
        assert sum(len(r.old or ()) for r in rows) > 100
