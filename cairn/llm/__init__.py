"""Operators for preparing language-model training data, as Spark jobs.

Every operator takes and returns DataFrames.  Common rules, unless an operator's docstring says otherwise:

* a null text counts as the empty text; rows with null ids are kept;
* repeated rows are kept and each gets the same result;
* an empty table gives an empty result with the same schema;
* columns the operator doesn't know pass through; a column that has the name of a result column is replaced.

Nothing else in the library imports this subpackage.
"""
