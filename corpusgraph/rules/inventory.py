"""Fixed values of the version and dependency inventory."""

SKIPPED_DIRS = ["vendor", "node_modules", ".git"]

MANIFEST_NAMES = [
    "composer.json", "Dockerfile", "develop.dockerfile", ".node-version", ".nvmrc",
    "package.json", "pyproject.toml", "requirements.txt", "go.mod", ".ruby-version", "Gemfile",
]

DIGEST_NAMES = [
    "composer.json", "composer.lock", "package.json", "package-lock.json",
    "go.mod", "go.sum", "Gemfile", "Gemfile.lock", "requirements.txt",
    "Pipfile", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle",
    "Dockerfile", "develop.dockerfile", "docker-compose.yml",
    ".node-version", ".nvmrc", ".ruby-version", ".python-version", ".tool-versions",
]

PHP_FRAMEWORKS = {
    "symfony/symfony": "Symfony", "symfony/framework-bundle": "Symfony",
    "laravel/framework": "Laravel", "cakephp/cakephp": "CakePHP",
    "slim/slim": "Slim", "yiisoft/yii2": "Yii2",
}
NODE_FRAMEWORKS = {
    "react": "React", "next": "Next.js", "vue": "Vue", "nuxt": "Nuxt",
    "@angular/core": "Angular", "svelte": "Svelte", "express": "Express",
    "gatsby": "Gatsby", "remix": "Remix",
}
RUBY_FRAMEWORKS = {"rails": "Rails", "sinatra": "Sinatra", "hanami": "Hanami"}
