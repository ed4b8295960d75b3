"""Multi-operator plans: scorecards, metric tables, hypothesis tests, model grids."""
