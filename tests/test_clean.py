"""Raw CSV files to clean tables, streams, stored variants, and the cascade on label files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from tabcascade import session
from tabcascade.operators.relational import cascade_merge
from tabcascade.operators.voting import with_vote
from tabcascade.plans.clean import CleanSpec, RawTables, apply_clean, fit_clean
from tabcascade.sources import SCHEMAS, read_csv, read_labels, write_clean, write_submission
from tabcascade.streaming import write_applied

EXTRAS = ["Online Security", "Online Backup", "Device Protection Plan", "Premium Tech Support", "Streaming TV", "Streaming Movies", "Streaming Music", "Unlimited Data"]


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """60 customers, a tenth of all cells missing in one of the usual spellings."""
    rng, folder = random.Random(5), tmp_path_factory.mktemp("raw")
    n = 60

    def cell(value):
        return rng.choice(["", "NA", "nan", "NULL"]) if rng.random() < 0.1 else value

    def yes():
        return rng.choice(["Yes", "No"])

    ids = [f"{i:04d}-ABCDE" for i in range(n)]
    people, places, services, scores, status = [], [], [], [], []
    for i, key in enumerate(ids):
        age, kin = rng.randint(18, 80), rng.choice([0, 0, 1, 2, 3])
        people.append([key, 1] + [cell(v) for v in (rng.choice(["Female", "Male"]), age, "Yes" if age < 30 else "No", "Yes" if age >= 65 else "No", yes(), "Yes" if kin else "No", kin)])
        z = i % 5
        places.append([key, 1, "United States", "California"] + [cell(v) for v in (f"City {z // 2}", 90000 + z, f"{30 + z}.5, -{110 + z}.25", f"{30 + z}.5", f"-{110 + z}.25")])
        t, m, d = rng.randint(1, 70), rng.randint(20, 100), rng.randint(0, 40)
        net = rng.choice(["Yes", "No"])
        back, extra = rng.choice([0, 2]), rng.choice([0, 5, 10])
        row = ["Yes", rng.randint(1, 4), rng.choice(["None", "Offer A"]), t, "Yes", d, yes(), net, "None" if net == "No" else rng.choice(["Cable", "DSL"]), 0 if net == "No" else 12]
        row += ["No" if net == "No" else yes() for _ in EXTRAS]
        row += ["One Year", yes(), "Credit Card", m, t * m, back, extra, t * d, t * m - back + extra + t * d]
        services.append([key, 1, "Q3"] + [cell(v) for v in row])
        scores.append([key, cell(rng.randint(1, 5))])
        status.append([key, cell(rng.choice(["No Churn", "No Churn", "Competitor", "Price", "Other"]))])
    files = {
        "demographics": (["Customer ID", "Count", "Gender", "Age", "Under 30", "Senior Citizen", "Married", "Dependents", "Number of Dependents"], people),
        "location": (["Customer ID", "Count", "Country", "State", "City", "Zip Code", "Lat Long", "Latitude", "Longitude"], places),
        "population": (["ID", "Zip Code", "Population"], [[i, 90000 + i, 1000 * (i + 1)] for i in range(4)]),
        "services": (
            ["Customer ID", "Count", "Quarter", "Referred a Friend", "Number of Referrals", "Offer", "Tenure in Months", "Phone Service",
             "Avg Monthly Long Distance Charges", "Multiple Lines", "Internet Service", "Internet Type", "Avg Monthly GB Download", *EXTRAS,
             "Contract", "Paperless Billing", "Payment Method", "Monthly Charge", "Total Charges", "Total Refunds", "Total Extra Data Charges",
             "Total Long Distance Charges", "Total Revenue"],
            services,
        ),
        "satisfaction": (["Customer ID", "Satisfaction Score"], scores),
        "status": (["Customer ID", "Churn Category"], status),
    }
    for name, (header, rows) in files.items():
        write(folder / f"{name}.csv", header, rows)
    tables = RawTables(**{name: read_csv(spark, str(folder / f"{name}.csv"), SCHEMAS[name]) for name in files})
    return spark.createDataFrame([(k,) for k in ids], "`Customer ID` string"), tables


def test_raw_files_to_clean_table(raw):
    ids, tables = raw
    train, test = ids.filter("`Customer ID` < '0045'"), ids.filter("`Customer ID` >= '0045'")
    model = fit_clean(train, tables)
    a, b = apply_clean(train, tables, model).cache(), apply_clean(test, tables, model)
    assert a.columns == b.columns and a.columns[-1] == "Churn Category" and a.columns[0] == "Customer ID"
    assert a.count() == 45 and b.count() == 15
    spec = CleanSpec()
    assert not set(spec.redundant) & set(a.columns) and not set(spec.categories) & set(a.columns)
    assert "Offer_None" in a.columns and "Internet Type_None" in a.columns
    for df in (a, b):
        nulls = df.select([F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in df.columns]).first().asDict()
        assert not any(nulls.values()), nulls
    stats = a.select([F.avg(F.col(f"`{c}`")).alias(c) for c in spec.scaled()]).first().asDict()
    assert all(abs(v) < 1e-9 for v in stats.values())
    assert {r[0] for r in a.select("Churn Category").distinct().collect()} <= {-1, 0, 1, 4, 5}
    for name in spec.categories:
        one_of = [c for c in a.columns if c.startswith(f"{name}_")]
        assert a.filter(sum(F.col(f"`{c}`") for c in one_of) != 1).count() == 0
    ranged = apply_clean(train, tables, model, "minmax").select(F.min("`Age`"), F.max("`Age`")).first()
    assert tuple(ranged) == (0.0, 1.0)
    plain = apply_clean(train, tables, model, None)
    # A known age is kept, an unknown one comes from its band.
    known = tables.demographics.filter("Age IS NOT NULL").select("Customer ID", F.col("Age").alias("was"))
    assert plain.join(known, "Customer ID").filter("Age <> was").count() == 0


def test_csv_spellings(spark, tmp_path):
    write(tmp_path / "t.csv", ["Customer ID", "Satisfaction Score"], [["a", "3"], ["b", "NA"], ["c", "n/a"], ["d", ""], ["e", "NaN"]])
    df = read_csv(spark, str(tmp_path / "t.csv"), SCHEMAS["satisfaction"])
    assert [r[1] for r in df.orderBy("Customer ID").collect()] == [3.0, None, None, None, None]
    write(tmp_path / "bad.csv", ["Customer ID", "Satisfaction Score"], [["a", "three"]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_csv(spark, str(tmp_path / "bad.csv"), SCHEMAS["satisfaction"]).collect()


def test_cascade_on_label_files(spark, tmp_path):
    """Stage one marks customers, stage two has reasons for exactly those."""
    first = [("0013-EXCHZ", 1), ("0014-BMAQU", 0), ("0021-IKXGC", 0), ("0023-HGHWL", 1), ("0030-FNXPP", 0), ("0036-IHMOT", 1)]
    second = [("0036-IHMOT", 4), ("0013-EXCHZ", 1), ("0023-HGHWL", 3)]
    write(tmp_path / "one.csv", ["Customer ID", "Churn Category"], first)
    write(tmp_path / "two.csv", ["Customer ID", "Churn Category"], second)
    one, two = [read_labels(spark, str(tmp_path / f), "Customer ID", "Churn Category") for f in ("one.csv", "two.csv")]
    write_submission(cascade_merge(one, two, "Customer ID", "Churn Category"), str(tmp_path / "out"), "Customer ID", "Churn Category")
    got = {tuple(r) for r in read_labels(spark, str(tmp_path / "out"), "Customer ID", "Churn Category").collect()}
    assert got == {(k, dict(second).get(k, 0)) for k, _ in first}


def test_variants_are_partitions(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 1.0)
    write_clean(df, str(tmp_path), "train", "std")
    write_clean(df, str(tmp_path), "train", "minmax")
    back = spark.read.parquet(str(tmp_path / "part=train"))
    assert {(r["norm"], r["n"]) for r in back.groupBy("norm").agg(F.count("*").alias("n")).collect()} == {("std", 5), ("minmax", 5)}


def test_apply_on_a_stream(spark, data, tmp_path):
    """A vote over columns is a projection, so it takes a stream unchanged."""
    path = f"{data}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(data)

    def voted(df):
        df = df.selectExpr("event_id", *[f"CAST((event_id * {k}) % 5 AS INT) AS m{k}" for k in (1, 2, 3)])
        return with_vote(df, ["m1", "m2", "m3"], range(5), "vote").select("event_id", "vote")

    query = write_applied(stream, voted, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert not query.isActive and query.exception() is None
    got, want = spark.read.parquet(str(tmp_path / "out")), voted(spark.read.parquet(path))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_checkpoint_dir_comes_from_the_session(spark, tmp_path, monkeypatch):
    class Context:
        master = "spark://cluster:7077"
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, conf):
            self.sparkContext, self.conf = Context(), Conf(conf)

    named = Session({"spark.checkpoint.dir": "/shared/checkpoints"})
    assert session.ensure_checkpoint_dir(named) == "/shared/checkpoints" == named.sparkContext.folder
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session({}))
