"""skein: a PySpark engine for moving, reshaping and checking tabular and nested data.

Operators are DataFrame -> DataFrame functions built on Spark SQL expressions and joins:

* ``skein.operators.pattern``  -- match / drop / search / wildcard / order / top-k / retrieve
* ``skein.operators.mutate``   -- default / map / select / remove / assign, rename, flatten, compose
* ``skein.operators.joins``    -- adjoin (1:1 lookup), conjoin (1:N), foreach_join
* ``skein.operators.aggregate`` / ``setops`` / ``maintain`` / ``codify`` / ``geometry``
* ``skein.sources`` / ``skein.sinks`` -- files, archives, JDBC; JSON/CSV/template/split/upsert sinks
* ``skein.plans`` -- encodings, pipelines (transfer), registry
* ``skein.streaming`` -- the same pipelines over arriving files
"""

__version__ = "0.1.0"
