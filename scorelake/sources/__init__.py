"""Reading datasets, benchmark rows, configurations and stored runs."""
