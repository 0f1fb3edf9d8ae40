"""PySpark analytics and forecasting for multi-entity sensor time series."""
