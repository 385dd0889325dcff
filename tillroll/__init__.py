"""tillroll: retail-sales analytics jobs expressed as Spark DataFrame plans.

Layers
------
sources    read the driver tables / CSV / literal rows, render the text staging
           layer and the typed star schema, write sinks
functions  shared column expressions (margins, shares, rounded averages, dates)
operators  distributed helpers Spark lacks as one call (global positions,
           NTILE / RANK / running sums without a single-partition window)
plans      the jobs themselves: views, business questions, data-quality
           checks, cleaning transforms, load assertions, validation suite
"""

from tillroll.session import ensure_checkpoint_dir, local_session

__all__ = ["ensure_checkpoint_dir", "local_session"]
