"""Registered queries and their SQL, one module per operator family."""

from .base import ORACLES, QUERIES  # noqa: F401
from . import labelling  # noqa: F401, E402
from . import masking  # noqa: F401, E402
from . import measuring  # noqa: F401, E402
from . import shaping  # noqa: F401, E402
from . import calibrating  # noqa: F401, E402
