"""Code-graph and text-corpus analytics as DataFrame operators."""
