from tabcascade.sources.files import (
    SCHEMAS,
    read_csv,
    read_labels,
    write_clean,
    write_submission,
)
from tabcascade.sources.models import load_models, save_models

__all__ = ["SCHEMAS", "load_models", "read_csv", "read_labels", "save_models", "write_clean", "write_submission"]
