"""bibflow: literature-search results as Spark tables.

Records landed as CSV, XML or HTML become one article table; that table is
filtered, capped, screened, compared between runs and searched with boolean
strategies. Every operator is a function on DataFrames.
"""
