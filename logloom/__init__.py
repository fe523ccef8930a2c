"""Session-log analytics on Spark."""

from logloom.functions.project import ProjectAlias
from logloom.operators.scope import Scope
from logloom.plans.summary import summarize
from logloom.schema import Corpus
from logloom.session import configure
from logloom.sources.corpus import load_corpus

__all__ = ["Corpus", "ProjectAlias", "Scope", "configure", "load_corpus", "summarize"]
