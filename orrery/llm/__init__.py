"""Training-data pipeline operators; nothing else in the library imports this package.

Conventions shared by all operators here:

* inputs are reduced to the columns an operator names before anything else,
  so extra columns (whatever they are called) never reach its internals;
* a NULL key row takes no part in an operator's result unless its docstring
  says otherwise; NULL and empty texts are "no tokens";
* intermediate tables go to ``spark.checkpoint.dir`` (see ``_store``).
"""
