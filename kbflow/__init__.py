"""kbflow: budgeted knowledge bases under query drift, expressed in PySpark."""
