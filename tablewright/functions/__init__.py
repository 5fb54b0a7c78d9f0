"""Column functions: text, numbers, urls and classifiers."""
