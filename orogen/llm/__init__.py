"""Training-data operators (text, vectors, web archives); nothing else in the package imports this one."""
