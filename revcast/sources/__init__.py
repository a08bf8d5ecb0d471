from revcast.sources.fixture import ad_daily  # noqa: F401
