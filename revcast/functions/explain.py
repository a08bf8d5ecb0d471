"""Feature-name explanations as column expressions (exact map, then pattern rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import lit_map


def _window_token(name: Column) -> Column:
    # third "_" token, e.g. revenue_roll_7d_mean -> 7d
    return F.try_element_at(F.split(name, "_"), F.lit(3))


def explain_feature(name: Column) -> Column:
    """Long, report-style explanation."""
    w = _window_token(name)
    rule = None
    for token, mean_text, std_text in K.FEATURE_PATTERNS:
        pre, post = mean_text.split("{w}")
        mean_expr = F.concat(F.lit(pre), w, F.lit(post))
        if std_text is not None:
            spre, spost = std_text.split("{w}")
            std_expr = F.concat(F.lit(spre), w, F.lit(spost))
            cond_std = name.contains(token) & name.contains("std")
            rule = F.when(cond_std, std_expr) if rule is None else rule.when(cond_std, std_expr)
        rule = rule.when(name.contains(token), mean_expr)
    for token, text in K.FEATURE_FALLBACKS:
        rule = rule.when(name.contains(token), F.lit(text))
    rule = rule.otherwise(F.lit(K.FEATURE_DEFAULT))
    return F.coalesce(F.try_element_at(lit_map(K.FEATURE_EXPLANATIONS), name), rule)


def explain_feature_short(name: Column) -> Column:
    """Short, dashboard-style explanation."""
    rule = None
    for token, text in K.FEATURE_PATTERNS_SHORT:
        cond = name.contains("roll") & name.contains(token)
        rule = F.when(cond, F.lit(text)) if rule is None else rule.when(cond, F.lit(text))
    for token, text in K.FEATURE_FALLBACKS_SHORT:
        rule = rule.when(name.contains(token), F.lit(text))
    rule = rule.otherwise(F.lit(K.FEATURE_DEFAULT))
    return F.coalesce(F.try_element_at(lit_map(K.FEATURE_EXPLANATIONS_SHORT), name), rule)
