"""Raw entity tables to the clean feature table, as one query.

The six raw tables are derived from ``customer`` and ``nation``; their columns
play the same roles as those of the customer files.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabcascade.bindings.base import Tables, query
from tabcascade.bindings.inference import NAMES as PLACE_NAMES
from tabcascade.bindings.inference import PEOPLE, PLACES, RULES_SQL, SERVICE, SERVICE_STEPS, dictionary_sql
from tabcascade.operators.billing import BillingColumns
from tabcascade.operators.inference import ServiceColumns
from tabcascade.plans.clean import CleanSpec, PersonColumns, RawTables, apply_clean, fit_clean

KEY = "c_custkey"
EXTRAS = list(SERVICE.extras)


def missing(value: str, mod: int, rest: int) -> str:
    return f"CASE WHEN c_custkey % {mod} = {rest} THEN NULL ELSE {value} END"


def yes_no(condition: str, mod: int, rest: int) -> str:
    return missing(f"CASE WHEN {condition} THEN 'Yes' ELSE 'No' END", mod, rest)


def number(value: str, mod: int, rest: int) -> str:
    return missing(f"CAST({value} AS DOUBLE)", mod, rest)


PERSON = {
    "gender": missing("CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END", 9, 4),
    "married": yes_no("c_custkey % 7 < 3", 8, 5),
    "young": yes_no("(c_custkey * 7) % 70 + 18 < 30", 6, 1),
    "senior": yes_no("(c_custkey * 7) % 70 + 18 >= 65", 7, 2),
    "age": number("(c_custkey * 7) % 70 + 18", 5, 3),
    "has_dependents": yes_no("c_custkey % 4 > 1", 11, 6),
    "dependents": number("CASE WHEN c_custkey % 4 > 1 THEN 1 + c_custkey % 5 ELSE 0 END", 10, 7),
}
TENURE, MONTHLY, DISTANCE = "(1 + c_custkey % 72)", "(CAST(20 + c_custkey % 90 AS DOUBLE) / 4)", "(CAST(c_custkey % 48 AS DOUBLE) / 4)"
REFUND, EXTRA = "(c_custkey % 9)", "(c_custkey % 14)"
BILLING = {
    "tenure": number(TENURE, 4, 1),
    "charges": number(f"{TENURE} * {MONTHLY}", 6, 5),
    "monthly": number(MONTHLY, 7, 3),
    "distance": number(f"{TENURE} * {DISTANCE}", 9, 2),
    "distance_avg": number(DISTANCE, 11, 8),
    "refunds": number(REFUND, 8, 3),
    "extra": number(EXTRA, 10, 9),
    "revenue": number(f"{TENURE} * {MONTHLY} - {REFUND} + {EXTRA} + {TENURE} * {DISTANCE}", 12, 1),
}
SERVICES = {
    "referred": yes_no("c_custkey % 5 > 2", 9, 7),
    "referrals": number("CASE WHEN c_custkey % 5 > 2 THEN 1 + c_custkey % 8 ELSE 0 END", 6, 4),
    "offer": missing("CASE WHEN c_custkey % 3 = 0 THEN 'None' WHEN c_custkey % 3 = 1 THEN 'Offer A' ELSE 'Offer B' END", 13, 5),
    "phone": yes_no("c_custkey % 10 > 0", 7, 5),
    "lines": yes_no("c_custkey % 10 > 4", 6, 2),
    "internet": yes_no("c_custkey % 5 > 0", 4, 2),
    "kind": missing(
        "CASE WHEN c_custkey % 5 = 0 THEN 'None' WHEN c_custkey % 5 = 1 THEN 'Cable' WHEN c_custkey % 5 = 2 THEN 'DSL' ELSE 'Fiber Optic' END", 8, 7
    ),
    "gb": number("CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 + c_custkey % 80 END", 9, 5),
    "contract": missing("CASE WHEN c_custkey % 4 < 2 THEN 'Month-to-Month' WHEN c_custkey % 4 = 2 THEN 'One Year' ELSE 'Two Year' END", 12, 7),
    "paperless": yes_no("c_custkey % 3 > 0", 10, 3),
    "payment": missing("CASE WHEN c_custkey % 6 < 3 THEN 'Bank Withdrawal' WHEN c_custkey % 6 < 5 THEN 'Credit Card' ELSE 'Mailed Check' END", 11, 2),
    **BILLING,
    **{x: yes_no(f"c_custkey % 5 > 0 AND (c_custkey * {i + 3}) % 7 < 3", 5 + i, i % 5) for i, x in enumerate(EXTRAS)},
}
CODES = {"No Churn": 0, "Competitor": 1, "Dissatisfaction": 2, "Attitude": 3, "Price": 4, "Other": 5}
STATUS = {
    "churn": missing(
        "CASE WHEN c_custkey % 16 < 10 THEN 'No Churn' WHEN c_custkey % 16 < 12 THEN 'Competitor' WHEN c_custkey % 16 = 12 THEN 'Dissatisfaction' "
        "WHEN c_custkey % 16 = 13 THEN 'Attitude' WHEN c_custkey % 16 = 14 THEN 'Price' ELSE 'Other' END",
        19,
        3,
    )
}
SCORE = {"score": number("1 + c_custkey % 5", 8, 6)}

LEVELS = {
    "gender": ["Female", "Male"],
    "married": ["No", "Yes"],
    "offer": ["None", "Offer A", "Offer B"],
    "phone": ["No", "Yes"],
    "lines": ["No", "Yes"],
    "internet": ["No", "Yes"],
    "kind": ["Cable", "DSL", "Fiber Optic", "None"],
    **{x: ["No", "Yes"] for x in EXTRAS},
    "contract": ["Month-to-Month", "One Year", "Two Year"],
    "paperless": ["No", "Yes"],
    "payment": ["Bank Withdrawal", "Credit Card", "Mailed Check"],
}
ROUNDED, MEANS, MODES = ["age", "tenure", "gb", "people", "score"], ["distance_avg", "monthly", "charges", "refunds", "extra", "distance", "revenue"], ["dependents", "referrals"]
SCALED = [*ROUNDED, *MEANS, *MODES]
SPEC = CleanSpec(
    key=KEY,
    label="churn",
    codes=CODES,
    unused=(),
    redundant=("young", "senior", "has_dependents", "city", "zip", "text", "referred"),
    categories=tuple(LEVELS),
    fill_rounded=ROUNDED,
    fill_mean=MEANS,
    fill_mode=MODES,
    fill_mode_text=("lat", "lon"),
    person=PersonColumns("age", "young", "senior", "dependents", "has_dependents", "referrals", "referred"),
    places=PLACE_NAMES,
    billing=BillingColumns("tenure", "charges", "monthly", "distance", "distance_avg", "refunds", "extra", "revenue"),
    service=ServiceColumns("phone", "lines", "internet", "kind", "gb", EXTRAS),
    place_order=KEY,
)
TRAIN = "c_custkey % 10 < 8"


def selected(columns: dict[str, str]) -> list[str]:
    return [KEY, *[f"{e} AS {n}" for n, e in columns.items()]]


def raw_tables(t: Tables) -> RawTables:
    c = t.customer
    return RawTables(
        demographics=c.selectExpr(*selected(PERSON)),
        location=c.selectExpr(*PLACES),
        population=t.nation.selectExpr(*PEOPLE),
        services=c.selectExpr(*selected(SERVICES)),
        satisfaction=c.selectExpr(*selected(SCORE)),
        status=c.selectExpr(*selected(STATUS)),
    )


# ---- the same in SQL: one CTE per step -------------------------------------------------------


class Steps:
    def __init__(self, first: str):
        self.parts = [f"s0 AS ({first})"]

    @property
    def last(self) -> str:
        return f"s{len(self.parts) - 1}"

    def replace(self, target: str, value: str) -> None:
        self.parts.append(f"s{len(self.parts)} AS (SELECT * REPLACE (COALESCE({target}, {value}) AS {target}) FROM {self.last})")

    def look_up(self, source: str, key: str, target: str) -> None:
        old = self.last
        self.parts.append(
            f"s{len(self.parts)} AS (SELECT o.* REPLACE (COALESCE(o.{target}, d.found) AS {target}) FROM {old} o "
            f"LEFT JOIN {dictionary_sql(source, key, target)} d ON o.{key} = d.{key})"
        )

    def add(self, select: str) -> None:
        self.parts.append(f"s{len(self.parts)} AS ({select})")

    def train(self, value: str, where: str = "TRUE", source: str = "") -> str:
        return f"(SELECT {value} FROM {source or self.last} WHERE {TRAIN} AND {where})"


def clean_sql() -> str:
    columns = [*selected(PERSON | SERVICES | SCORE | STATUS), *[p for p in PLACES if p != KEY]]
    s = Steps(f"SELECT {', '.join(columns)} FROM customer")
    raw = s.last

    def band(condition: str) -> str:
        return s.train("round_even(AVG(age), 0)", condition, raw)

    s.replace(
        "age",
        f"CASE WHEN young = 'Yes' THEN {band('age < 30')} WHEN senior = 'Yes' THEN {band('age >= 65')} "
        f"WHEN young = 'No' AND senior = 'No' THEN {band('age >= 30 AND age < 65')} END",
    )
    for value, flag in (("dependents", "has_dependents"), ("referrals", "referred")):
        mean = s.train(f"round_even(AVG({value}), 0)", f"{flag} = 'Yes'", raw)
        s.replace(value, f"CASE WHEN {flag} = 'Yes' THEN {mean} WHEN {flag} = 'No' THEN 0 END")
    s.look_up(raw, "lon", "lat")
    s.look_up(raw, "lat", "lon")
    s.replace("text", "CAST(lat AS VARCHAR) || ', ' || CAST(lon AS VARCHAR)")
    for i, c in enumerate(("lat", "lon"), 1):
        s.add(f"SELECT * REPLACE (COALESCE(TRY_CAST(split_part(text, ', ', {i}) AS DOUBLE), {c}) AS {c}) FROM {s.last}")
    s.look_up(s.last, "text", "zip")
    placed = s.last
    s.add(f"SELECT {', '.join(PEOPLE)} FROM nation")
    pop = s.last
    s.add(
        f"SELECT city, COALESCE(SUM(people), 0) AS total, COUNT(people) AS zips FROM (SELECT DISTINCT city, zip FROM {placed} WHERE city IS NOT NULL) q "
        f"LEFT JOIN {pop} pop ON q.zip = pop.zip GROUP BY city"
    )
    per = s.last
    s.add(
        f"SELECT p.*, CAST(COALESCE(pop.people, CASE WHEN per.zips > 0 THEN round_even(CAST(per.total AS DOUBLE) / per.zips, 0) WHEN per.zips = 0 THEN 0 END, "
        f"CASE WHEN p.city IS NULL THEN (SELECT round_even(CAST(SUM(total) AS DOUBLE) / SUM(zips), 0) FROM {per}) END) AS DOUBLE) AS people "
        f"FROM {placed} p LEFT JOIN {pop} pop ON p.zip = pop.zip LEFT JOIN {per} per ON p.city = per.city"
    )
    for _ in range(3):
        for _, target, value in RULES_SQL:
            s.replace(target, value)
    for target, value in SERVICE_STEPS.values():
        s.replace(target, value)
    off = ", ".join(f"COALESCE({x}, CASE WHEN internet = 'No' THEN 'No' END) AS {x}" for x in EXTRAS)
    s.add(f"SELECT * REPLACE ({off}) FROM {s.last}")
    known = s.last
    fills = [f"COALESCE({c}, {s.train(f'round_even(AVG({c}), 0)', source=known)}) AS {c}" for c in ROUNDED]
    fills += [f"COALESCE({c}, {s.train(f'AVG({c})', source=known)}) AS {c}" for c in MEANS]
    for c in [*MODES, "lat", "lon", *LEVELS]:
        tie = f"CAST({c} AS VARCHAR)" if c in ("lat", "lon") else c
        mode = f"(SELECT {c} FROM {known} WHERE {TRAIN} AND {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {tie} LIMIT 1)"
        fills.append(f"COALESCE({c}, {mode}) AS {c}")
    s.add(f"SELECT * REPLACE ({', '.join(fills)}) FROM {known}")
    filled = s.last
    out = [KEY, "lat", "lon"]
    out += [f"round(({c} - {s.train(f'AVG({c})', source=filled)}) / {s.train(f'stddev_samp({c})', source=filled)}, 5) AS {c}" for c in SCALED]
    out += [f"CAST({c} = '{v}' AS INT) AS \"{c}_{v}\"" for c, values in LEVELS.items() for v in values]
    codes = " ".join(f"WHEN churn = '{v}' THEN {n}" for v, n in CODES.items())
    out.append(f"CAST(CASE WHEN churn IS NULL THEN -1 {codes} END AS INT) AS churn")
    return f"WITH {', '.join(s.parts)} SELECT {', '.join(out)} FROM {filled}"


@query("L2_clean_table", clean_sql())
def clean_table(t: Tables):
    """All steps from raw tables to the clean table, fitted on the training ids."""
    raw = raw_tables(t)
    ids = t.customer.select(KEY)
    model = fit_clean(ids.filter(TRAIN), raw, SPEC)
    clean = apply_clean(ids, raw, model)
    return clean.withColumns({c: F.round(c, 5) for c in SCALED})


