"""Registration of queries beside their SQL."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def query(self, oracle: str | None = None, doubles: str = ""):
        """Registers a query under its name; the columns in ``doubles`` are rounded to six places on both sides."""
        names = doubles.split()

        def keep(f):
            @wraps(f)
            def run(spark, sf_dir):
                return f(spark, sf_dir).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in names})

            self.queries[f.__name__] = run
            if oracle:
                rounded = ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in names)
                self.oracles[f.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({oracle})" if names else oracle
            return run

        return keep
