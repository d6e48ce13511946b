"""Source-code corpus curation, labelling and analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver except small bounded metadata (per-partition block counts).
"""

from codecorpus.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
