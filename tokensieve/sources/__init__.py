"""Where tables come from, and where intermediate ones go."""
