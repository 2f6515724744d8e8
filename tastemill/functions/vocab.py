"""Fixed vocabularies of the data model, in their order of codes."""

# Genre names (as features name them), gender and age codes, occupation labels.
GENRES = ("Action", "Adventure", "Animation", "Children", "Comedy", "Crime", "Documentary", "Drama", "Fantasy", "Film-Noir", "Horror", "Musical", "Mystery", "Romance", "Sci-Fi", "Thriller", "War", "Western")
GENDERS = ("F", "M")
AGES = (1, 18, 25, 35, 45, 50, 56)
OCCUPATIONS = (
    "other", "academic/educator", "artist", "clerical/admin", "college/grad student", "customer service", "doctor/health care",
    "executive/managerial", "farmer", "homemaker", "K-12 student", "lawyer", "programmer", "retired", "sales/marketing", "scientist",
    "self-employed", "technician/engineer", "tradesman/craftsman", "unemployed", "writer",
)
YEARS = (2000, 2050)
