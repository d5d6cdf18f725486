"""Where graphs and catalogue answers come from, and where graphs go."""
