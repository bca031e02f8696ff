"""tidyspark: a tidy data grammar whose verbs build lazy Spark plans and whose functions build columns."""

from .functions.aggregates import *  # noqa: F403
from .functions.conditional import *  # noqa: F403
from .functions.factors import *  # noqa: F403
from .functions.math import *  # noqa: F403
from .functions.strings import *  # noqa: F403
from .functions.udf import func_bootstrap, func_factory, register_func, register_verb, user_function
from .functions.windows import *  # noqa: F403
from .operators.columns import *  # noqa: F403
from .operators.groups import *  # noqa: F403
from .operators.joins import *  # noqa: F403
from .operators.reshape import *  # noqa: F403
from .operators.slices import *  # noqa: F403
from .plans.expr import f
from .plans.select import all_of, any_of, c, contains, ends_with, everything, last_col, matches, num_range, starts_with, where
from .plans.tbl import Tbl
from .sources.tables import *  # noqa: F403
