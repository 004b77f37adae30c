"""Forecasting, serving and the nightly run, composed from the operators."""
