"""tribewise: community and topic analytics as Spark DataFrame operators.

Every operator takes DataFrames (plus column-name parameters) and returns a
lazy DataFrame.  Nothing is collected to the driver except bounded values:
scalars, parameter grids, a vocabulary capped by ``vocab_size`` and the
stop checks of iterative algorithms.
"""

from tribewise.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
