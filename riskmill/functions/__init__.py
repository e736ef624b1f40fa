"""Column functions: text, hashing, scoring, prompts."""
