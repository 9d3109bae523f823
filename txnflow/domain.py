"""Domain configuration: rule tables, word lists and codes.

The operators never hard-code a rule or a word; they take a :class:`Domain`.
Two domains ship:

* ``BANK_DOMAIN`` -- the values the original bank pipeline uses (Chinese
  location and transaction wording).  A user of that pipeline gets identical
  categories, tokens and cash-flow signs by passing it.
* ``TESTDATA_DOMAIN`` -- an English rule table written for the synthetic tables
  under ``/root/testdata`` (part names and types stand in for transaction
  wording, brand + part name for ATM locations).

Rules are ordered; the first matching rule wins (SQL ``CASE WHEN``).  A rule
matches when any of its clauses matches; a clause matches when every regex in
``contains`` matches, no regex in ``not_contains`` matches, ``equals`` (if set)
equals the text, and the amount test (if set) holds.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Clause:
    contains: tuple[str, ...] = ()
    not_contains: tuple[str, ...] = ()
    equals: str | None = None
    amount: str | None = None  # one of None, ">0", "=0"


@dataclass(frozen=True)
class Rule:
    label: str
    clauses: tuple[Clause, ...]


def rule(label: str, *contains: str, amount: str | None = None,
         not_contains: tuple[str, ...] = (), equals: str | None = None) -> Rule:
    return Rule(label, (Clause(tuple(contains), tuple(not_contains), equals, amount),))


def pattern_rule(pattern: str, label: str) -> Rule:
    return rule(label, pattern)


@dataclass(frozen=True)
class Domain:
    name: str
    home_bank_code: str
    home_currencies: tuple[str, ...]
    unknown: str
    online_location: str
    atm_event: str
    excluded_event: str
    location_dash: str
    location_rules: tuple[Rule, ...]
    location_default: str
    action_rules: tuple[Rule, ...]
    action_default: str
    stop_words: tuple[str, ...]
    token_strip: str
    lexicon: tuple[str, ...]
    cash_out_pattern: str
    cash_out_exclude: str
    enquiry_category_pattern: str
    fill_columns: tuple[str, ...] = field(default=(
        "action_type", "txn_currency_code", "txn_type_desc",
        "target_acct_nbr", "target_bank_code", "target_customer_id"))


# ---------------------------------------------------------------------------
# FIXED VALUES -- must equal the original bank pipeline's values for the same
# results (location categories, action categories, stop words, cash-flow
# wording, codes).  Listed as given, in their original order.
# ---------------------------------------------------------------------------
BANK_DOMAIN = Domain(
    name="bank",
    home_bank_code="013",
    home_currencies=("TWD", "unknown"),
    unknown="unknown",
    online_location="線上交易",
    atm_event="atm_transaction",
    excluded_event="cathaybk_browse",
    location_dash="—",
    location_rules=(
        pattern_rule("分行", "分行"),
        pattern_rule("全家", "全家"),
        pattern_rule("萊爾富", "萊爾富"),
        pattern_rule("7-ELEVEN", "7-ELEVEN"),
        pattern_rule("全聯", "全聯"),
        pattern_rule("COSTCO", "COSTCO"),
        pattern_rule("IKEA", "IKEA"),
        pattern_rule("大潤發", "大潤發"),
        pattern_rule("大買家", "大買家"),
        pattern_rule("微風|新光三越|TIGER CITY|美麗華百樂園|環球購物中心|大葉高島屋|禮客時尚館|"
                     "大魯閣草衙道購物中心–商場三樓|大魯閣草衙道購物中心–商場一樓|桃園ATT筷時尚|"
                     "ATT 4 LIFE|巨城購物中心|維春—日耀百貨|大江國際購物中心1樓", "百貨"),
        pattern_rule("捷運", "捷運"),
        pattern_rule("寒舍艾麗酒店|喜來登|大億麗緻酒店", "餐飲旅宿"),
        pattern_rule("分局", "分局"),
        pattern_rule("醫院", "醫院"),
        pattern_rule("科大|學院|大學|商學館", "大學"),
        pattern_rule("運動中心", "運動中心"),
        pattern_rule("國壽|A3置地大樓|營業部", "國壽相關據點"),
        pattern_rule("誠品", "誠品"),
        pattern_rule("線上交易", "線上交易"),
        pattern_rule("證券", "證券公司"),
        pattern_rule("unknown", "unknown"),
    ),
    location_default="其他未歸類",
    action_rules=(
        rule("轉帳_繳費", "停車費|國民年金|水費|中華電信|台電|繳稅|遠傳電信|國壽保險費|信用卡費|繳費", amount=">0"),
        Rule("轉帳_保單", (Clause(("保單貸款|保單借款", "轉帳")),
                         Clause(("國壽保單借款",), amount=">0"))),
        rule("轉帳_外匯", "外匯", "轉帳", amount=">0"),
        rule("轉帳_理財型房貸", "理財型房貸", "轉帳", amount=">0"),
        rule("轉帳_電子式存單", "電子式存單", "轉帳", amount=">0"),
        rule("轉帳_網銀約轉", "網銀約轉", "轉帳", amount=">0"),
        rule("轉帳_網銀非約轉", "網銀非約轉", "轉帳", amount=">0"),
        rule("轉帳_信用卡繳費", "信用卡", "轉帳", amount=">0"),
        rule("轉帳_存單開戶存摺扣款", "存單開戶存摺扣款", "轉帳", amount=">0"),
        rule("轉帳_個人轉帳", "轉帳_ unknown|跨行轉帳|轉帳交易|轉出交易", amount=">0"),
        rule("申購", "申購"),
        rule("定存", "定存"),
        rule("匯款_外匯", "外匯匯款"),
        rule("提款_外幣", "外幣提款", amount=">0"),
        rule("提款_非外幣", "自行提款", amount=">0"),
        rule("現金貸方_存款", "存款", "現金貸方"),
        rule("現金借方_其他", "保單|理財", "現金借方"),
        rule("現鈔繳信用卡款", "現鈔繳信用卡款"),
        rule("網路消費", "網路消費|露天付款快手|拍賣"),
        rule("愛心捐款", "愛心捐款"),
        rule("查詢_約定", "約定帳號查詢", "查詢"),
        rule("查詢_存款", "存款", "查詢"),
        rule("查詢_卡片", "卡片", "查詢"),
        rule("查詢_其他", "查詢", not_contains=("約定帳號查詢|存款|卡片",)),
        Rule("其他_有金額_unknown", (Clause(("一般_轉換",), amount=">0"),
                                  Clause(("unknown _",), amount=">0"))),
        rule("其他_無金額_unknown", equals="unknown _", amount="=0"),
        rule("其他_無金額_NCWINQ", equals="NCWINQ _"),
        rule("其他_無金額_RPTSND", equals="RPTSND _"),
        rule("其他_無金額_ACNIQ6", equals="ACNIQ6 _"),
        rule("其他_無金額_CIFIQ1", equals="CIFIQ1 _"),
        rule("其他_無金額_PACSET", equals="PACSET _"),
        rule("其他_無金額_CIFCHG", equals="CIFCHG _"),
        rule("其他_無金額_NCWSET", equals="NCWSET _"),
        rule("其他_無金額_NCWPCG", equals="NCWPCG _"),
    ),
    action_default="其他_未歸類",
    stop_words=("/", "-", " ", "--", "(", ")", "unknown", "店", "站", "金牌", "漾店", "分院", "中心", "服務",
                "鄰店", "三文", "大樓", "三厝", "新大樓", "通訊", "第二", "D", "棟", "1F", "22F", "國際大樓",
                "愛心店", "限", "使用", "讚", "二店", "南店", "二校區", "新", "有店", "婦幼", "櫃", "航廈", "和",
                "三", "二", "東店", "三店", "金", "交流", "愛萊店", "綠"),
    token_strip="店",
    lexicon=(),  # the bank's own location lexicon is a separate input file
    cash_out_pattern=("停車費|國民年金|水費|中華電信|台電|繳稅|遠傳電信|國壽保險費|信用卡費|繳信用卡|繳他人信用卡款|"
                      "繳費|貸款|外匯|約轉|扣款|轉帳_ unknown|跨行轉帳|自行轉帳|轉帳交易|轉出交易|申購|提款|"
                      "現金貸方|轉帳貸方|還款|現鈔繳信用卡款|網路消費|一般_轉換|拍賣|露天付款|unknown _|領現|"
                      "愛心捐款"),
    cash_out_exclude="存款|解約",
    enquiry_category_pattern="查詢|其他_無金額_",
)


# ---------------------------------------------------------------------------
# English domain for the synthetic test tables.  Transaction wording is
# "<part type> <part name>", ATM locations are "<brand> <part name>".
# ---------------------------------------------------------------------------
TESTDATA_DOMAIN = Domain(
    name="testdata",
    home_bank_code="013",
    home_currencies=("TWD", "unknown"),
    unknown="unknown",
    online_location="online",
    atm_event="atm_transaction",
    excluded_event="browse",
    location_dash="#",
    location_rules=(
        pattern_rule("anvil", "anvil"),
        pattern_rule("gear|gizmo", "gear_gizmo"),
        pattern_rule("red|blue", "coloured"),
        pattern_rule("Brand 1[0-9]", "brand_teens"),
        pattern_rule("online", "online"),
        pattern_rule("unknown", "unknown"),
    ),
    location_default="other",
    action_rules=(
        rule("promo_small_goods", "PROMO", "widget|gizmo", amount=">0"),
        Rule("economy_hardware", (Clause(("ECONOMY", "bolt")),
                                  Clause(("ECONOMY .*gear",), amount=">0"))),
        rule("large_paid", "LARGE", amount=">0"),
        rule("standard_plate_ring", "STANDARD|MEDIUM", "plate|ring", amount=">0"),
        rule("small", "SMALL"),
        rule("anvil_plain", "anvil", not_contains=("hot|cold",)),
        rule("unknown_paid", "unknown", amount=">0"),
        rule("unknown_free", equals="unknown unknown", amount="=0"),
        rule("medium_new_rod", equals="MEDIUM new rod"),
    ),
    action_default="other",
    stop_words=(" ", "\n", ".", ",", "#", "-", "(", ")", "unknown", "the", "of", "and", "de", "la", "le",
                "der", "die", "und", "el", "los", "en"),
    token_strip="'",
    lexicon=("Brand 1", "Brand 17", "red widget", "blue bolt", "hot plate"),
    cash_out_pattern="PROMO|LARGE|ECONOMY|widget|gear|unknown unknown",
    cash_out_exclude="rod|ring",
    enquiry_category_pattern="small|_free",
)

# Sequence feature selection (the model input).  FIXED VALUES: the per-step
# keys left out of the model tensor, and the 22 features that remain.
SEQUENCE_EXCLUDED_KEYS = ("label", "clust_index", "time_diff", "cash_flow", "twd_amt", "cat_location",
                          "action_time_month", "action_time_day", "action_time_hour", "action_time_dayOfWeek")
MODEL_FEATURES = ("isCrossBank", "isSelfTrans", "action_time_isWeekend_1", "action_time_periodOfDay_1",
                  "action_time_periodOfDay_2", "action_time_periodOfDay_3", "event_atm_transaction",
                  "event_myatm_transaction", "isExchangeDeal", "location_token_0", "location_token_1",
                  "location_token_2", "location_token_3", "location_token_4", "cat_action_0", "cat_action_1",
                  "cat_action_2", "cat_action_3", "cash_flow_-1", "cash_flow_1", "twd_amt_scaled",
                  "time_diff_scaled")
# Features of MODEL_FEATURES that do not come from a PCA projection.
NON_PCA_FEATURES = tuple(f for f in MODEL_FEATURES
                         if not f.startswith(("location_token_", "cat_action_")))
