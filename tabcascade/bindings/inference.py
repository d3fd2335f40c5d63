"""Queries for the rules that infer missing values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import Tables, query, sub
from tabcascade.operators.billing import PASSES, BillingColumns, identity_rules, solve_identities
from tabcascade.operators.inference import (
    PlaceColumns,
    ServiceColumns,
    apply_band_means,
    apply_flagged_mean,
    apply_places,
    download_without_internet,
    extras_without_internet,
    fill_null,
    fit_band_means,
    fit_flagged_mean,
    fit_places,
    internet_from_download,
    internet_from_extras,
    internet_from_type,
    phone_rules,
    service_rules,
    type_without_internet,
)

# ---- bands and flagged counts -----------------------------------------------------------

SIZES = [
    "p_partkey",
    "CASE WHEN p_partkey % 4 = 1 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS age",
    "CASE WHEN p_partkey % 9 = 2 THEN NULL WHEN p_size < 15 THEN 'Yes' ELSE 'No' END AS young",
    "CASE WHEN p_partkey % 7 = 3 THEN NULL WHEN p_size >= 35 THEN 'Yes' ELSE 'No' END AS senior",
    "CASE WHEN p_partkey % 10 < 8 THEN 1 ELSE 0 END AS is_train",
]


@query(
    "I1_age_band",
    f"""WITH p AS {sub('part', SIZES)},
    s AS (SELECT round_even(AVG(CASE WHEN age < 15 THEN age END), 0) AS young, round_even(AVG(CASE WHEN age >= 15 AND age < 35 THEN age END), 0) AS middle,
      round_even(AVG(CASE WHEN age >= 35 THEN age END), 0) AS senior FROM p WHERE is_train = 1)
    SELECT p_partkey, CAST(COALESCE(age, CASE WHEN p.young = 'Yes' THEN s.young WHEN p.senior = 'Yes' THEN s.senior
      WHEN p.young = 'No' AND p.senior = 'No' THEN s.middle END) AS DOUBLE) AS age FROM p, s""",
)
def age(t: Tables):
    df = t.part.selectExpr(*SIZES)
    means = fit_band_means(df.filter("is_train = 1"), "age", 15, 35)
    return apply_band_means(df, means, "age", "young", "senior").select("p_partkey", "age")


def flagged_sql(table: str, key: str, value: str, flag: str) -> str:
    return f"""WITH d AS {table}, s AS (SELECT round_even(AVG({value}), 0) AS m FROM d WHERE {flag} = 'Yes' AND is_train = 1)
    SELECT {key}, CAST(COALESCE({value}, CASE WHEN {flag} = 'Yes' THEN m WHEN {flag} = 'No' THEN 0 END) AS DOUBLE) AS {value} FROM d, s"""


KIN = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE CAST(o_custkey % 9 AS DOUBLE) END AS dependents",
    "CASE WHEN o_orderkey % 8 = 6 THEN NULL WHEN o_custkey % 9 > 4 THEN 'Yes' ELSE 'No' END AS has_dependents",
    "CASE WHEN o_orderkey % 10 < 8 THEN 1 ELSE 0 END AS is_train",
]


@query("I2_dependents", flagged_sql(sub("orders", KIN), "o_orderkey", "dependents", "has_dependents"))
def dependents(t: Tables):
    df = t.orders.selectExpr(*KIN)
    mean = fit_flagged_mean(df.filter("is_train = 1"), "dependents", "has_dependents")
    return apply_flagged_mean(df, mean, "dependents", "has_dependents").select("o_orderkey", "dependents")


REFERRALS = [
    "c_custkey",
    "CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE CAST(c_nationkey % 12 AS DOUBLE) END AS referrals",
    "CASE WHEN c_custkey % 5 = 3 THEN NULL WHEN c_nationkey % 12 > 3 THEN 'Yes' ELSE 'No' END AS referred",
    "CASE WHEN c_custkey % 10 < 8 THEN 1 ELSE 0 END AS is_train",
]


@query("I9_referrals", flagged_sql(sub("customer", REFERRALS), "c_custkey", "referrals", "referred"))
def referrals(t: Tables):
    df = t.customer.selectExpr(*REFERRALS)
    mean = fit_flagged_mean(df.filter("is_train = 1"), "referrals", "referred")
    return apply_flagged_mean(df, mean, "referrals", "referred").select("c_custkey", "referrals")


# ---- places --------------------------------------------------------------------------------

# Two nations share a longitude, and a place has up to three zip codes, so that
# the later of two dictionary entries matters.
TRUE_LAT = "(CAST(c_nationkey AS DOUBLE) + CAST(0.5 AS DOUBLE))"
TRUE_LON = "(CAST(CASE WHEN c_nationkey = 4 THEN 3 ELSE c_nationkey END AS DOUBLE) * CAST(-2 AS DOUBLE) - CAST(0.25 AS DOUBLE))"
PLACES = [
    "c_custkey",
    "CASE WHEN c_custkey % 17 = 2 THEN NULL ELSE concat('CITY_', CAST(c_nationkey % 20 AS STRING)) END AS city",
    f"CASE WHEN c_custkey % 5 IN (1, 2) THEN NULL ELSE {TRUE_LAT} END AS lat",
    f"CASE WHEN c_custkey % 7 IN (1, 3) THEN NULL ELSE {TRUE_LON} END AS lon",
    f"CASE WHEN c_custkey % 3 <> 0 THEN NULL ELSE concat(CAST({TRUE_LAT} AS STRING), ', ', CAST({TRUE_LON} AS STRING)) END AS text",
    "CASE WHEN c_custkey % 11 IN (2, 5, 7) THEN NULL ELSE c_nationkey * 10 + c_custkey % 3 END AS zip",
]
NAMES = PlaceColumns("lat", "lon", "text", "zip", "city", "people")
# The first digits of the zip codes stand for no known population.
PEOPLE = ["n_nationkey * 10 AS zip", "CAST(1000 + n_nationkey * 37 AS BIGINT) AS people"]


def dictionary_sql(source: str, key: str, value: str) -> str:
    return f"""(SELECT {key}, arg_max({value}, first_seen) AS found FROM (SELECT {key}, {value}, MIN(c_custkey) AS first_seen
      FROM {source} WHERE {key} IS NOT NULL AND {value} IS NOT NULL GROUP BY {key}, {value}) GROUP BY {key})"""


PLACES_SQL = f"""WITH raw AS {sub('customer', PLACES)},
  a AS (SELECT raw.* REPLACE (COALESCE(raw.lat, d.found) AS lat) FROM raw LEFT JOIN {dictionary_sql('raw', 'lon', 'lat')} d ON raw.lon = d.lon),
  b AS (SELECT a.* REPLACE (COALESCE(a.lon, d.found) AS lon) FROM a LEFT JOIN {dictionary_sql('raw', 'lat', 'lon')} d ON a.lat = d.lat),
  c AS (SELECT * REPLACE (COALESCE(text, CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR)) AS text) FROM b),
  e AS (SELECT * REPLACE (COALESCE(TRY_CAST(split_part(text, ', ', 1) AS DOUBLE), lat) AS lat, COALESCE(TRY_CAST(split_part(text, ', ', 2) AS DOUBLE), lon) AS lon) FROM c),
  f AS (SELECT e.* REPLACE (COALESCE(e.zip, d.found) AS zip) FROM e LEFT JOIN {dictionary_sql('e', 'text', 'zip')} d ON e.text = d.text)"""


def completed(t: Tables, people: bool = False, keep_known: bool = True, **how):
    places = t.customer.selectExpr(*PLACES)
    population = t.nation.selectExpr(*PEOPLE) if people else None
    model = fit_places(places, NAMES, "c_custkey", population, keep_known, **how)
    return apply_places(places, model, **how)


@query("I3_latitude", f"{PLACES_SQL} SELECT c_custkey, lat FROM f")
def latitude(t: Tables):
    return completed(t).select("c_custkey", "lat")


@query("I4_longitude", f"{PLACES_SQL} SELECT c_custkey, lon FROM f")
def longitude(t: Tables):
    return completed(t).select("c_custkey", "lon")


@query("I5_coordinate_text", f"{PLACES_SQL} SELECT c_custkey, text FROM f")
def coordinate_text(t: Tables):
    return completed(t).select("c_custkey", "text")


@query(
    "I6_coordinate_split",
    PLACES_SQL.replace("COALESCE(TRY_CAST(split_part(text, ', ', 1) AS DOUBLE), lat)", "TRY_CAST(split_part(text, ', ', 1) AS DOUBLE)").replace(
        "COALESCE(TRY_CAST(split_part(text, ', ', 2) AS DOUBLE), lon)", "TRY_CAST(split_part(text, ', ', 2) AS DOUBLE)"
    )
    + " SELECT c_custkey, lat, lon FROM f",
)
def coordinate_split(t: Tables):
    return completed(t, keep_known=False).select("c_custkey", "lat", "lon")


@query("I7_zip_code", f"{PLACES_SQL} SELECT c_custkey, CAST(zip AS BIGINT) AS zip FROM f")
def zip_code(t: Tables):
    return completed(t).select("c_custkey", "zip")


POPULATION_SQL = f"""{PLACES_SQL}, pop AS {sub('nation', PEOPLE)},
  per AS (SELECT city, COALESCE(SUM(people), 0) AS people, COUNT(people) AS zips
    FROM (SELECT DISTINCT city, zip FROM f WHERE city IS NOT NULL) q LEFT JOIN pop ON q.zip = pop.zip GROUP BY city),
  pooled AS (SELECT round_even(CAST(SUM(people) AS DOUBLE) / SUM(zips), 0) AS m FROM per)
  SELECT f.c_custkey, CAST(COALESCE(pop.people, round_even(CASE WHEN per.zips > 0 THEN CAST(per.people AS DOUBLE) / per.zips ELSE 0.0 END, 0),
    CASE WHEN f.city IS NULL THEN pooled.m END) AS DOUBLE) AS people
  FROM f LEFT JOIN pop ON f.zip = pop.zip LEFT JOIN per ON f.city = per.city, pooled"""
# Rows with a city always have a mean, so the CASE for unknown zips applies only
# where the population join found nothing.
POPULATION_SQL = POPULATION_SQL.replace("round_even(CASE WHEN per.zips", "round_even(CASE WHEN per.city IS NULL THEN NULL WHEN per.zips")


@query("I8_population", POPULATION_SQL)
def population(t: Tables):
    return completed(t, people=True).select("c_custkey", "people")


@query("J4_city_zip_population", POPULATION_SQL)
def population_by_place(t: Tables):
    """The same with the lookups counted as too big to broadcast."""
    return completed(t, people=True, broadcast_limit=0).select("c_custkey", "people")


# ---- billing -----------------------------------------------------------------------------------

MIX = "(l_orderkey * 7 + l_partkey * 3 + l_suppkey + l_linenumber)"
MONTHLY = "(CASE WHEN l_suppkey % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(l_partkey % 200 AS DOUBLE) / 4 END)"
DISTANCE = "(CAST(l_suppkey % 60 AS DOUBLE) / 2)"
TENURE = "(CASE WHEN l_orderkey % 23 = 0 THEN CAST(0 AS DOUBLE) ELSE l_quantity END)"
REFUND = "(CAST(l_linenumber AS DOUBLE) / 4)"
EXTRA = "(CAST(l_orderkey % 40 AS DOUBLE))"
REVENUE = f"({TENURE} * {MONTHLY} - {REFUND} + {EXTRA} + {TENURE} * {DISTANCE})"


def hidden(value: str, mod: int, rest: str) -> str:
    return f"CASE WHEN {MIX} % {mod} IN ({rest}) THEN NULL ELSE {value} END"


BILLING = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    hidden(TENURE, 5, "0, 1") + " AS tenure",
    hidden(f"{TENURE} * {MONTHLY}", 7, "2, 3") + " AS charges",
    hidden(MONTHLY, 11, "1, 4, 8") + " AS monthly",
    hidden(f"{TENURE} * {DISTANCE}", 13, "0, 5, 6") + " AS distance",
    hidden(DISTANCE, 17, "3, 9, 10") + " AS distance_avg",
    hidden(REFUND, 6, "2") + " AS refunds",
    hidden(EXTRA, 9, "4, 5") + " AS extra",
    hidden(REVENUE, 8, "1, 6") + " AS revenue",
]
AMOUNTS = ["tenure", "charges", "monthly", "distance", "distance_avg", "refunds", "extra", "revenue"]
BILL = BillingColumns(*AMOUNTS)
RULES_SQL = [
    ("I10_tenure_from_charges", "tenure", "ceil(charges / NULLIF(monthly, 0))"),
    ("I11_charges_from_tenure", "charges", "tenure * monthly"),
    ("I12_monthly_from_tenure", "monthly", "charges / NULLIF(tenure, 0)"),
    ("I13_tenure_from_distance", "tenure", "ceil(distance / NULLIF(distance_avg, 0))"),
    ("I14_distance_from_tenure", "distance", "tenure * distance_avg"),
    ("I15_distance_avg_from_tenure", "distance_avg", "distance / NULLIF(tenure, 0)"),
    ("I16_revenue", "revenue", "charges - refunds + extra + distance"),
    ("I17_charges_from_revenue", "charges", "revenue + refunds - extra - distance"),
    ("I18_refunds_from_revenue", "refunds", "charges + extra + distance - revenue"),
    ("I19_extra_from_revenue", "extra", "revenue - charges + refunds - distance"),
    ("I20_distance_from_revenue", "distance", "revenue - charges + refunds - extra"),
]
ROUNDED_SQL = ", ".join(["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"] + [f"round({a}, 4) AS {a}" for a in AMOUNTS])


def rounded(df):
    return df.withColumns({a: F.round(a, 4) for a in AMOUNTS})


def _rule(position: int, name: str, target: str, value: str) -> None:
    @query(name, f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(COALESCE({target}, {value}), 4) AS {target} FROM {sub('lineitem', BILLING)}")
    def one_rule(t: Tables):
        column, candidate = identity_rules(BILL)[position]
        df = fill_null(t.lineitem.selectExpr(*BILLING), column, candidate)
        return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(column, 4).alias(column))


for _i, _parts in enumerate(RULES_SQL):
    _rule(_i, *_parts)


def fixpoint_sql(passes: int) -> str:
    steps = [f"s0 AS {sub('lineitem', BILLING)}"]
    for _ in range(passes):
        for _, target, value in RULES_SQL:
            steps.append(f"s{len(steps)} AS (SELECT * REPLACE (COALESCE({target}, {value}) AS {target}) FROM s{len(steps) - 1})")
    return f"WITH {', '.join(steps)} SELECT {ROUNDED_SQL} FROM s{len(steps) - 1}"


# The oracle runs all rules, and one pass more than the operator, which must change nothing.
@query("I21_fixpoint", fixpoint_sql(len(PASSES) + 1))
def fixpoint(t: Tables):
    return rounded(solve_identities(t.lineitem.selectExpr(*BILLING), BILL))


# ---- services ------------------------------------------------------------------------------------

EXTRAS = [f"extra{i}" for i in range(1, 9)]
SERVICES = [
    "o_orderkey",
    "CASE WHEN o_orderkey % 4 = 1 THEN NULL WHEN o_custkey % 6 = 0 THEN 'No' ELSE 'Yes' END AS phone",
    "CASE WHEN o_orderkey % 5 = 2 THEN NULL WHEN o_custkey % 6 = 0 OR o_custkey % 3 = 1 THEN 'No' ELSE 'Yes' END AS lines",
    "CASE WHEN o_orderkey % 3 = 1 THEN NULL WHEN o_custkey % 5 < 2 THEN 'No' ELSE 'Yes' END AS internet",
    "CASE WHEN o_orderkey % 7 IN (1, 4) THEN NULL WHEN o_custkey % 5 < 2 THEN 'None' WHEN o_custkey % 5 = 2 THEN 'Cable' "
    "WHEN o_custkey % 5 = 3 THEN 'DSL' ELSE 'Fiber Optic' END AS kind",
    "CASE WHEN o_orderkey % 8 IN (2, 5) THEN NULL WHEN o_custkey % 5 < 2 THEN CAST(0 AS DOUBLE) ELSE CAST(o_custkey % 90 AS DOUBLE) END AS gb",
] + [
    f"CASE WHEN o_orderkey % {mod} IN (0, 3) THEN NULL WHEN o_custkey % 5 < 2 OR (o_custkey + o_orderkey) % {mod} < {mod // 2} THEN 'No' ELSE 'Yes' END AS {name}"
    for name, mod in zip(EXTRAS, (4, 5, 6, 7, 9, 10, 11, 13))
]
SERVICE = ServiceColumns("phone", "lines", "internet", "kind", "gb", EXTRAS)
ANY_EXTRA = " OR ".join(f"{x} = 'Yes'" for x in EXTRAS)
SERVICE_STEPS = {
    "I22_phone_service": ("phone", "CASE WHEN lines = 'Yes' THEN 'Yes' END"),
    "I23_multiple_lines": ("lines", "CASE WHEN phone = 'No' THEN 'No' END"),
    "I24_internet_from_type": ("internet", "CASE WHEN kind IN ('Cable', 'DSL', 'Fiber Optic') THEN 'Yes' END"),
    "I25_internet_from_download": ("internet", "CASE WHEN gb > 0 THEN 'Yes' END"),
    "I26_internet_from_extras": ("internet", f"CASE WHEN {ANY_EXTRA} THEN 'Yes' END"),
    "I27_internet_type": ("kind", "CASE WHEN internet = 'No' THEN 'None' END"),
    "I28_download": ("gb", "CASE WHEN internet = 'No' THEN 0 END"),
}
EXTRA_STEP = ", ".join(f"COALESCE({x}, CASE WHEN internet = 'No' THEN 'No' END) AS {x}" for x in EXTRAS)
SERVICE_RULES = {
    "I22_phone_service": phone_rules,
    "I23_multiple_lines": phone_rules,
    "I24_internet_from_type": internet_from_type,
    "I25_internet_from_download": internet_from_download,
    "I26_internet_from_extras": internet_from_extras,
    "I27_internet_type": type_without_internet,
    "I28_download": download_without_internet,
}


def _service(name: str, target: str, value: str) -> None:
    source = sub("orders", SERVICES)
    if name == "I23_multiple_lines":
        phone = SERVICE_STEPS["I22_phone_service"][1]
        source = f"(SELECT * REPLACE (COALESCE(phone, {phone}) AS phone) FROM {source})"

    @query(name, f"SELECT o_orderkey, COALESCE({target}, {value}) AS {target} FROM {source}")
    def one_rule(t: Tables):
        return SERVICE_RULES[name](t.orders.selectExpr(*SERVICES), SERVICE).select("o_orderkey", target)


for _name, (_target, _value) in SERVICE_STEPS.items():
    _service(_name, _target, _value)


@query("I29_extras", f"SELECT * REPLACE ({EXTRA_STEP}) FROM {sub('orders', SERVICES)}")
def extras(t: Tables):
    return extras_without_internet(t.orders.selectExpr(*SERVICES), SERVICE)


def overwritten_sql() -> str:
    steps = [f"s0 AS {sub('orders', SERVICES)}"]
    for x in EXTRAS:
        steps.append(
            f"s{len(steps)} AS (SELECT * REPLACE (COALESCE({x}, CASE WHEN internet = 'No' THEN 'No' END) AS internet) FROM s{len(steps) - 1})"
        )
    return f"WITH {', '.join(steps)} SELECT o_orderkey, internet FROM s{len(steps) - 1}"


@query("I29_extras_compat", overwritten_sql())
def extras_compat(t: Tables):
    return extras_without_internet(t.orders.selectExpr(*SERVICES), SERVICE, compat=True).select("o_orderkey", "internet")


def services_sql() -> str:
    steps = [f"s0 AS {sub('orders', SERVICES)}"]
    for target, value in SERVICE_STEPS.values():
        steps.append(f"s{len(steps)} AS (SELECT * REPLACE (COALESCE({target}, {value}) AS {target}) FROM s{len(steps) - 1})")
    return f"WITH {', '.join(steps)} SELECT * REPLACE ({EXTRA_STEP}) FROM s{len(steps) - 1}"


@query("I22_I29_service_rules", services_sql())
def all_services(t: Tables):
    return service_rules(t.orders.selectExpr(*SERVICES), SERVICE)

