"""Personal-data discovery as Spark DataFrame jobs.

The flow is corpus rows (path, text) -> findings -> per-file profile ->
protection level -> reports.  Everything up to the profile of a one-row file
is a narrow projection; only small keys are ever shuffled.
"""
