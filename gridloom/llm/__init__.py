"""Operators for training-data pipelines over document tables.

Nothing else in the library imports this subpackage.  Shared conventions, which
every operator's docstring refers to as *the usual edge cases*:

* a null text counts as the empty text; a null id passes through;
* texts of any length are processed whole;
* a repeated row gives a repeated result row unless the docstring says otherwise;
* an empty table gives an empty result with the full schema;
* only the named id and text columns are read, so extra columns may carry any name.
"""
