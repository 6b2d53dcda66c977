"""Column builders: genotype, variant, chromosome, annotation and seeded-draw expressions. All run on the JVM."""
