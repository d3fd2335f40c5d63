"""Raw customer tables to a clean feature table, fitted on training ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from tabcascade.functions import code_label
from tabcascade.operators.billing import BillingColumns, solve_identities
from tabcascade.operators.inference import (
    BandMeans,
    PlaceColumns,
    PlaceModel,
    ServiceColumns,
    apply_band_means,
    apply_flagged_mean,
    apply_places,
    band_means,
    fit_places,
    flagged_mean,
    service_rules,
)
from tabcascade.operators.prepare import (
    FillSpec,
    Scaling,
    apply_fill,
    apply_one_hot,
    apply_scaling,
    fit_fill,
    fit_levels,
    fit_scalings,
)
from tabcascade.operators.relational import assemble, label_last
from tabcascade.session import hold

# Label codes.
CHURN_CODES = {
    "No Churn": 0,
    "Competitor": 1,
    "Dissatisfaction": 2,
    "Attitude": 3,
    "Price": 4,
    "Other": 5,
}


@dataclass(frozen=True)
class RawTables:
    demographics: DataFrame
    location: DataFrame
    population: DataFrame
    services: DataFrame
    satisfaction: DataFrame
    status: DataFrame


@dataclass(frozen=True)
class PersonColumns:
    age: str = "Age"
    young: str = "Under 30"
    senior: str = "Senior Citizen"
    dependents: str = "Number of Dependents"
    has_dependents: str = "Dependents"
    referrals: str = "Number of Referrals"
    referred: str = "Referred a Friend"


@dataclass(frozen=True)
class CleanSpec:
    """Column roles; the defaults are fixed values of the customer tables."""

    key: str = "Customer ID"
    label: str = "Churn Category"
    codes: Mapping[str, int] = field(default_factory=lambda: dict(CHURN_CODES))
    unused: Sequence[str] = ("Count", "Quarter", "ID")
    redundant: Sequence[str] = (
        "Under 30",
        "Senior Citizen",
        "Dependents",
        "Country",
        "State",
        "City",
        "Zip Code",
        "Lat Long",
        "Referred a Friend",
    )
    categories: Sequence[str] = (
        "Gender",
        "Married",
        "Offer",
        "Phone Service",
        "Multiple Lines",
        "Internet Service",
        "Internet Type",
        "Online Security",
        "Online Backup",
        "Device Protection Plan",
        "Premium Tech Support",
        "Streaming TV",
        "Streaming Movies",
        "Streaming Music",
        "Unlimited Data",
        "Contract",
        "Paperless Billing",
        "Payment Method",
    )
    fill_rounded: Sequence[str] = (
        "Age",
        "Tenure in Months",
        "Avg Monthly GB Download",
        "Population",
        "Satisfaction Score",
    )
    fill_mean: Sequence[str] = (
        "Avg Monthly Long Distance Charges",
        "Monthly Charge",
        "Total Charges",
        "Total Refunds",
        "Total Extra Data Charges",
        "Total Long Distance Charges",
        "Total Revenue",
    )
    fill_mode: Sequence[str] = ("Number of Dependents", "Number of Referrals")
    fill_mode_text: Sequence[str] = ("Latitude", "Longitude")
    person: PersonColumns = PersonColumns()
    places: PlaceColumns = PlaceColumns()
    billing: BillingColumns = BillingColumns()
    service: ServiceColumns = ServiceColumns()
    place_order: str = "Customer ID"
    keep_known_coordinates: bool = True
    compat_extras: bool = False

    def scaled(self) -> list[str]:
        return [*self.fill_rounded, *self.fill_mean, *self.fill_mode]


@dataclass(frozen=True)
class CleanModel:
    spec: CleanSpec
    age: BandMeans
    dependents: float | None
    referrals: float | None
    places: PlaceModel
    fill: Mapping = field(default_factory=dict)
    levels: Mapping[str, Sequence[str]] = field(default_factory=dict)
    scaling: Mapping[str, Scaling] = field(default_factory=dict)


def assemble_raw(ids: DataFrame, raw: RawTables, spec: CleanSpec = CleanSpec()) -> DataFrame:
    tables = [raw.demographics, raw.location, raw.services, raw.satisfaction, raw.status]
    return assemble(ids.select(spec.key), [t.drop(*spec.unused) for t in tables], spec.key)


def infer(df: DataFrame, model: CleanModel, **how) -> DataFrame:
    """All row and lookup rules, in order; later rules see earlier results."""
    spec, who = model.spec, model.spec.person
    df = apply_band_means(df, model.age, who.age, who.young, who.senior)
    df = apply_flagged_mean(df, model.dependents, who.dependents, who.has_dependents)
    df = apply_places(df, model.places, **how)
    df = apply_flagged_mean(df, model.referrals, who.referrals, who.referred)
    df = solve_identities(df, spec.billing)
    return service_rules(df, spec.service, spec.compat_extras).drop(*spec.redundant)


def _fit_inference(train_ids: DataFrame, raw: RawTables, spec: CleanSpec, **how) -> CleanModel:
    """Statistics of training rows, from the few columns they need, and the place
    dictionaries, which come from the places of all rows."""
    who = spec.person
    people = assemble(
        train_ids.select(spec.key),
        [
            raw.demographics.select(spec.key, who.age, who.dependents, who.has_dependents),
            raw.services.select(spec.key, who.referrals, who.referred),
        ],
        spec.key,
    )
    row = people.agg(
        *band_means(who.age),
        flagged_mean(who.dependents, who.has_dependents).alias("dependents"),
        flagged_mean(who.referrals, who.referred).alias("referrals"),
    ).first()
    places = fit_places(
        raw.location.drop(*spec.unused),
        spec.places,
        spec.place_order,
        raw.population.drop(*spec.unused),
        spec.keep_known_coordinates,
        **how,
    )
    return CleanModel(spec, BandMeans(row["young"], row["middle"], row["senior"]), row["dependents"], row["referrals"], places)


def fit_clean(train_ids: DataFrame, raw: RawTables, spec: CleanSpec = CleanSpec(), **how) -> CleanModel:
    """Fit every step on the training ids.

    The inferred training rows are read by a handful of aggregations, each of a
    few columns, and are held for them.
    """
    model = _fit_inference(train_ids, raw, spec, **how)
    known = hold(infer(assemble_raw(train_ids, raw, spec), model, **how))
    fill = fit_fill(
        known,
        FillSpec(spec.fill_rounded, spec.fill_mean, (), spec.fill_mode, [*spec.fill_mode_text, *spec.categories]),
    )
    filled = apply_fill(known, fill)
    fitted = replace(model, fill=fill, levels=fit_levels(filled, spec.categories), scaling=fit_scalings(filled, spec.scaled()))
    known.unpersist()
    return fitted


def apply_clean(ids: DataFrame, raw: RawTables, model: CleanModel, norm: str | None = "std", **how) -> DataFrame:
    """The clean table of any id list; ``norm`` is ``std``, ``minmax`` or None."""
    spec = model.spec
    df = infer(assemble_raw(ids, raw, spec), model, **how)
    df = apply_one_hot(apply_fill(df, model.fill), model.levels)
    if norm is not None:
        df = apply_scaling(df, model.scaling[norm])
    return label_last(df.withColumn(spec.label, code_label(spec.label, spec.codes)), spec.label)
