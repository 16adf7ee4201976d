"""Linear and logistic regression, prediction and metrics."""
