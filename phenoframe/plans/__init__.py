"""The seven phenotyping pipelines."""

from .blood_pressure import blood_pressure  # noqa: F401
from .body_mass import bmi  # noqa: F401
from .ethnicity import ethnicity_modal, ethnicity_recent_all, ethnicity_recent_primary  # noqa: F401
from .glucose import blood_glucose  # noqa: F401
from .smoking import smoking  # noqa: F401
