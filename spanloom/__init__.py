"""Text-pattern analytics on Spark: regular-expression searches over columns of text or bytes."""

from spanloom.functions.pattern import LimitError, Options, PatternError, Regex, UnsupportedPattern, check_rewrite, escape, quote_meta
from spanloom.functions.sets import OrderedMany, RegexSet

__all__ = ["LimitError", "Options", "OrderedMany", "PatternError", "Regex", "RegexSet", "UnsupportedPattern", "check_rewrite", "escape", "quote_meta"]
