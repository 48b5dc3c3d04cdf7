"""Pay and work model against cases of known outcome."""

from pyspark.sql import functions as F

from rolesift.functions import pay, work

TIERS = ["Standard areas: $152,100-$190,100. ", "Higher cost of living areas: $167,300 - $209,100. ", "Lower cost of living areas: $136,900-$171,100. "]
PAY = {
    "For hourly roles: vacation accrued at about 1 hour for every 25.97 hours worked. " + "filler " * 30 + "The base pay range: $142,800 — $210,000 USD": (142800, 210000),
    "$85 - $95 per hour": (176800, 197600),
    "$136K - $204K": (136000, 204000),
    "$136K \xe2€“ $204K • Offers Equity": (136000, 204000),
    "$159,780.00 -- $238,080.00": (159780, 238080),
    "between $150,000 and $180,000": (150000, 180000),
    "$150k through $180k": (150000, 180000),
    "We raised a $200M Series C": (None, None),
    "We raised a $200,000 round": (None, None),
    "The base salary for this role is $185,000 per year": (185000, 185000),
    "Competitive compensation": (None, None),
    "".join(TIERS): (167300, 209100),
    TIERS[2] + TIERS[0]: (152100, 190100),
    TIERS[2]: (136900, 171100),
    "$100,000 - $120,000 here. $150,000 - $190,000 there.": (100000, 120000),
    "The base salary range is 292,000 USD - 442,750 USD": (292000, 442750),
    "116,000 USD - 184,000 USD for Level 3, and 136,000 USD - 224,250 USD for Level 4": (116000, 184000),
    "US: $186000 - $269000 (USD) + 20% bonus target": (186000, 269000),
    "The pay range for this role is: 105,000 - 175,000 USD per year": (105000, 175000),
    "a fleet of 105,000 - 175,000 USD machines": (None, None),
    "we raised 50M USD in Series C funding": (None, None),
    "Our ARR grew from 10 USD to 100 USD": (None, None),
    "": (None, None),
    None: (None, None),
}

LONG = "plain words " * 200
WORK = [
    (("Hybrid", True, "San Francisco HQ", ""), "Hybrid"),
    (("Remote", True, "Remote - US", ""), "Remote"),
    (("Office", None, "Remote", "#LI-Remote"), "On-site"),
    (("FullTime", None, "Remote", None), "Remote"),
    ((None, True, "United States - Remote", ""), "Remote"),
    ((None, None, "New York", ""), "On-site"),
    ((None, None, None, None), "On-site"),
    ((None, None, "Austin", "a hybrid work team #LI-Onsite"), "On-site"),
    ((None, None, "Austin", "a hybrid work team #li-on-site"), "On-site"),
    ((None, None, "Austin", "#LI-Hybrid"), "Hybrid"),
    ((None, None, "Hybrid", "#LI-Remote"), "Remote"),
    ((None, None, " United States ", "on-site"), "Remote"),
    ((None, None, "nationwide", ""), "Remote"),
    ((None, None, "Austin, United States", ""), "On-site"),
    ((None, None, "Austin", "hybrid cloud"), "On-site"),
    ((None, None, "Austin", LONG + "We are a hybrid team"), "Hybrid"),
    ((None, None, "Austin", LONG + "hybrid environment"), "Hybrid"),
    ((None, None, "Austin", "expected to work from the office 3+ days a week"), "Hybrid"),
    ((None, None, "Austin", "three days per week"), "Hybrid"),
    ((None, None, "Austin", "onsite Tuesday, Wednesday, and Thursday"), "Hybrid"),
    ((None, None, "Austin", "in the office at least two days"), "Hybrid"),
    ((None, None, "Austin", "in the office. Two days"), "On-site"),
    ((None, True, "Austin", "plain"), "On-site"),
    ((None, True, "Austin", "work from home"), "Remote"),
    ((None, True, "Austin", "work from home or in person"), "On-site"),
    ((None, True, "Austin", LONG + "remote"), "On-site"),
    ((None, False, "Austin", "remote"), "On-site"),
]


def test_pay(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(PAY)], "i int, t string")
    got = {r.i: (r.p.low, r.p.high) for r in rows.select("i", pay.pay_range("t").alias("p")).collect()}
    assert {t: got[i] for i, t in enumerate(PAY)} == PAY


def test_work_model(spark):
    rows = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(WORK)], "i int, s string, f boolean, l string, b string")
    got = {r.i: r.w for r in rows.select("i", work.work_model(F.col("s"), F.col("f"), F.col("l"), F.col("b")).alias("w")).collect()}
    assert [(WORK[i], got[i]) for i in sorted(got) if WORK[i][1] != got[i]] == []


NAMES = {
    "Restricted stock for all": (True, False), "share options": (True, False), "an ownership stake": (True, False), "RSUs": (True, False), "We are equitable": (False, False),
    "variable compensation": (False, True), "incentive compensation": (False, True), "Commission": (False, True), "a bonus": (False, True), "bonuses": (False, False), "Stock options and bonus": (True, True), "": (False, False), None: (False, False),
}
RATES = {"15% annual bonus": 0.15, "a bonus target of up to 12.5%": 0.125, "20% target performance bonus": 0.2, "bonus": None, "10% off": None, None: None}


def test_equity_bonus_and_rates(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(NAMES)], "i int, t string")
    got = {r.i: (r.e, r.b) for r in rows.select("i", pay.names_equity("t").alias("e"), pay.names_bonus("t").alias("b")).collect()}
    assert {t: got[i] for i, t in enumerate(NAMES)} == NAMES
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(RATES)], "i int, t string")
    got = {r.i: r.r for r in rows.select("i", pay.stated_bonus("t").alias("r")).collect()}
    assert {t: got[i] for i, t in enumerate(RATES)} == RATES
