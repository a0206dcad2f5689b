"""The three dataflows: preparation, exploration and forecasting."""
