"""corpusterms: term mining over text corpora as Spark DataFrame operators.

A corpus is a DataFrame ``(document, text)``.  ``sources`` make corpora
from Parquet tables, wiki XML dumps and document folders; ``operators`` turn
them into token, term, n-gram and score tables; ``streaming`` keeps a store
of those tables up to date; ``functions`` holds the Column expressions they
are built from; ``plans`` registers the queries checked against SQL.
"""

__version__ = "0.1.0"
