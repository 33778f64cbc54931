"""Text analytics and topic models as DataFrame operators."""
