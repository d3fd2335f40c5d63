"""Numbered model families on disk, and estimators rebuilt from stored models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.base import Model
from pyspark.sql import SparkSession

from tabcascade.plans.ledger import side_by_side


def member_path(folder: str, number: int) -> str:
    return f"{folder}/model_{number}"


def save_models(models: Sequence[Model], folder: str) -> list[str]:
    paths = [member_path(folder, i) for i in range(len(models))]

    def save(model: Model, path: str) -> None:
        whole = model if isinstance(model, PipelineModel) else PipelineModel([model])
        whole.write().overwrite().save(path)

    side_by_side(SparkSession.active(), [lambda m=m, p=p: save(m, p) for m, p in zip(models, paths)], 8)
    return paths


def load_models(folder: str, count: int) -> list[PipelineModel]:
    return [PipelineModel.load(member_path(folder, i)) for i in range(count)]


def stored_params(model: Model) -> dict:
    """Every parameter value a fitted model carries, defaults included, by name.

    Of a stored pipeline the last stage counts; of one-vs-rest the first class.
    """
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "models"):
        last = last.models[0]
    return {p.name: v for p, v in last.extractParamMap().items()}


def unfitted(kind: type[Estimator], params: dict, **override) -> Estimator:
    """A new estimator of ``kind`` with stored parameters, without the fit."""
    estimator = kind()
    values = params | override
    known = {n: v for n, v in values.items() if estimator.hasParam(n) and v is not None}
    return estimator._set(**known).copy()
