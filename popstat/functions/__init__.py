from popstat.functions.scalars import *  # noqa: F401,F403
from popstat.functions.text import *  # noqa: F401,F403
