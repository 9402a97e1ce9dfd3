from tidewater.sources.tables import read_table  # noqa: F401
