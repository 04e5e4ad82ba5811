"""Token-selection methods, composed of operators."""
