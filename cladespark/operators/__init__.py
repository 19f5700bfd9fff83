"""Tree, distance and placement operators."""
