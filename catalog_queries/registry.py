"""Collects the queries of a module with their SQL twins."""


class Registry(dict):
    """name -> (function of session and folder, SQL or None)"""

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self[name] = (fn, sql)
            return fn

        return register
