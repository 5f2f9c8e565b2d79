"""Session configuration for scale, and helpers to inspect physical plans."""

from plantpulse.plans.config import checkpoint_root, get_session, scale_conf  # noqa: F401
from plantpulse.plans.inspect import (  # noqa: F401
    assert_no_python_udf, count_operator, plan_formatted, plan_text,
)
