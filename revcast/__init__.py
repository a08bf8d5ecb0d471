"""revcast — probabilistic ad-revenue forecasting as Spark DataFrame plans.

Layout
------
sources/    vendor exports, the unified fixture view, sinks
functions/  column expressions (maps, guarded ratios, caps, labels)
operators/  DataFrame -> DataFrame steps (clean, features, forecast, insights)
plans/      composed end-to-end plans and the query registry
llm/        operators for large training-text tables (stand-alone)
"""

__version__ = "0.1.0"
