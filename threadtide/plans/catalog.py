"""Every registered query; importing the parts fills the registry."""

from threadtide.plans import queries_comments, queries_match, queries_models, queries_resample, queries_text, queries_threads, queries_users  # noqa: F401
from threadtide.plans.registry import ENTRIES  # noqa: F401
