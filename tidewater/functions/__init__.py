from tidewater.functions.constants import *  # noqa: F401,F403
from tidewater.functions.expressions import *  # noqa: F401,F403
