"""vatlens: process-data analytics on Spark DataFrames.

Cleaning, feature derivation, ordered (per-run) differences, distribution
summaries, regression training / scoring / evaluation, run history and
threshold alerts. Every operator takes and returns DataFrames and is
parameterised by column names; the bioprocess naming lives only in
``vatlens.plans.preset``.
"""

from vatlens.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
