"""functions of millrace."""
