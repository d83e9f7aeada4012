"""Composite plans: the weather resolution pipeline, the energy ⋈ weather table, forecasting and
model comparison, and the stand-in mapping of the test tables."""
