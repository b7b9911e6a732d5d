"""Column-expression helpers shared by the operators (all JVM-side)."""

from tabflow.functions.columns import *  # noqa: F401,F403
from tabflow.functions.ranking import hash_rank, prefix_sums  # noqa: F401
