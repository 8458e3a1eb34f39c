"""DataFrame operators of the loyalty analytics and incrementality engine."""
