"""Column functions: text, vectors, codes and encoders."""
