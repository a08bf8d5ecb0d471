from revcast.functions.expr import *  # noqa: F401,F403
from revcast.functions.explain import explain_feature, explain_feature_short  # noqa: F401
