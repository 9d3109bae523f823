"""The original pipeline's fixed values (BANK_DOMAIN) on hand-made rows."""

from pyspark.sql import functions as F

from txnflow.domain import BANK_DOMAIN as B
from txnflow.functions import flags, rules, text


def test_location_categories(spark):
    rows = [("國泰世華分行",), ("全家—台北車站店",), ("線上交易",), ("某某地點",),
            ("大魯閣草衙道購物中心–商場三樓",),   # en dash: kept, matches the department-store pattern
            ("維春—日耀百貨",),                  # em dash is replaced first, so this pattern cannot match
            ("台北捷運站",), ("unknown",)]
    df = spark.createDataFrame(rows, "loc string")
    loc = text.replace_text(F.col("loc"), B.location_dash, " ")
    got = [r[0] for r in df.select(rules.classify(loc, B.location_rules, B.location_default)).collect()]
    assert got == ["分行", "全家", "線上交易", "其他未歸類", "百貨", "其他未歸類", "捷運", "unknown"]


def test_action_categories_and_cash_flow(spark):
    rows = [("self", 500.0, "轉帳 繳費"), ("self", 0.0, "轉帳 繳費"), ("self", 100.0, "unknown _"),
            ("self", 0.0, "unknown _"), ("self", 0.0, "約定帳號查詢 查詢"), ("self", 300.0, "存款 現金貸方"),
            ("self", 300.0, "跨行轉帳 unknown"), ("others", 300.0, "跨行轉帳 unknown")]
    df = spark.createDataFrame(rows, "sponsor string, amt double, txt string")
    cat = rules.classify(F.col("txt"), B.action_rules, B.action_default, F.col("amt"))
    out = df.select(cat.alias("cat"), "sponsor", "amt", "txt")
    out = out.select("cat", flags.cash_flow(F.col("sponsor"), F.col("amt"), F.col("txt"), F.col("cat"), B).alias("cf"))
    got = [(r.cat, r.cf) for r in out.collect()]
    assert got == [("轉帳_繳費", -1),                 # paid bill: outflow
                   ("其他_未歸類", 1),                # no amount: no rule, inflow by default
                   ("其他_有金額_unknown", -1),
                   ("其他_無金額_unknown", 0),        # zero-amount enquiry-like category
                   ("查詢_約定", 0),
                   ("現金貸方_存款", 1),              # '存款' excludes the outflow reading
                   ("轉帳_個人轉帳", -1),
                   ("轉帳_個人轉帳", 1)]             # not self-initiated


def test_location_tokens_with_bank_stop_words(spark):
    df = spark.createDataFrame([("全家—台北車站店",), ("7-ELEVEN 鄰店",)], "loc string")
    docs = [r[0] for r in df.select(text.location_document(
        F.col("loc"), B.location_dash, ("台北車站", "7-ELEVEN", "鄰店"), B.stop_words, B.token_strip)).collect()]
    assert docs == ["全 家 台北車站", "7-ELEVEN"]
