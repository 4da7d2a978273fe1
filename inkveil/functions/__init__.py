"""Text, validators and sanitisers as column expressions, and the pattern catalog."""
