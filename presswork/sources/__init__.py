from presswork.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
