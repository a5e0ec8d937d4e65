"""Work, KPI and CRM analytics on Spark DataFrames."""
