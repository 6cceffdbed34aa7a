"""Event and market analytics on Spark DataFrames.

Every public function takes DataFrames and returns a lazy DataFrame that covers all
symbols, portfolios or models at once.
"""
