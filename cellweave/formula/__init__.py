"""Formula text: values, syntax trees, addresses."""
