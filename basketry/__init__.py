"""basketry: commerce analytics on Spark.

Layout
  sources/    shop tables over the driver parquet (``fixture``), the typed
              schemas, a distributed generator, parquet write/read
  functions/  column expressions: rounding/ratio rules, dates, draws
  operators/  reusable DataFrame operators: global windows, top-k, pivot,
              pairs, first-event / argmin rows, audits
  plans/      the named analyses, operator keys, ad-hoc SQL, catalogue and
              the DuckDB oracle texts
"""

from basketry.session import configure, local_session  # noqa: F401
from basketry.sources.fixture import Shop, TableShop, load  # noqa: F401
