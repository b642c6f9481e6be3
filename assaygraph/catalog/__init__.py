"""Named queries over the driver tables and their SQL oracles."""

from . import q_scoring  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
from . import q_clean  # noqa: F401,E402
from . import q_validate  # noqa: F401,E402
from . import q_features  # noqa: F401,E402
from . import q_eval  # noqa: F401,E402
from . import q_graph  # noqa: F401,E402
from . import q_scalar  # noqa: F401,E402
from . import q_models  # noqa: F401,E402
from . import q_io  # noqa: F401,E402
