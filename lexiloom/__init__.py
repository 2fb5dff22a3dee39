"""Text-corpus and conversation analytics as DataFrame plans."""
